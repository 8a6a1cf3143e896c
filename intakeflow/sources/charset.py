"""Charset detection from samples of a file (S6): coding rules, then pair and class frequencies.

A charset is in question where its strict decoder takes all samples.  Among those left the one counts under which
the bytes are most likely: its characters fall into classes (frequent ones first, each with its share of texts and its
number of characters), and letters follow one another with the chances of its scripts - accented Latin letters stand
among plain ones, Cyrillic or Chinese ones among their own.  The confidence is the winner's share of the
likelihood times the share of its characters that are in frequent classes; under ``LEAST`` it is utf-8.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

LEAST = 0.5  # fixed value: confidence under which utf-8 is taken
SAMPLE = 32768  # fixed value: bytes of the head and of the middle
FEW = 256  # bytes beyond ASCII under which samples tell too little

_ASCII = bytes(range(0x80))
_HIGH = re.compile(rb"[\x80-\xff]")

BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"),
        (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))

# Classes of a charset's characters beyond ASCII: pattern, share of text, characters in it, whether it is frequent.
_TWO = rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]"
_EUC = rb"[\xa1-\xfe][\xa1-\xfe]"
_CLASSES = {
    "gb18030": [(rb"[\xb0-\xd7][\xa1-\xfe]", 0.85, 3760, True), (rb"[\xa1-\xa3][\xa1-\xfe]", 0.12, 282, True),
                (_TWO + rb"|[\x81-\xfe][0-9][\x81-\xfe][0-9]", 0.03, 20000, False)],
    "big5": [(rb"[\xa4-\xc6][\x40-\x7e\xa1-\xfe]", 0.85, 5401, True), (rb"[\xa1-\xa3][\x40-\x7e\xa1-\xfe]", 0.12, 408, True),
             (_TWO, 0.03, 8000, False)],
    "shift_jis": [(rb"\x82[\x9f-\xf1]|\x83[\x40-\x96]", 0.5, 169, True), (rb"\x81[\x40-\xac]|\x82[\x4f-\x9a]", 0.1, 170, True),
                  (rb"[\x88-\x97][\x40-\x7e\x80-\xfc]", 0.36, 2965, True),
                  (rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]", 0.04, 4000, False)],
    "euc_jp": [(rb"[\xa4\xa5][\xa1-\xf6]", 0.5, 169, True), (rb"[\xa1\xa3][\xa1-\xfe]", 0.1, 170, True),
               (rb"[\xb0-\xcf][\xa1-\xfe]", 0.36, 2965, True), (_EUC + rb"|\x8e[\xa1-\xdf]|\x8f" + _EUC, 0.04, 9000, False)],
    "euc_kr": [(rb"[\xb0-\xc8][\xa1-\xfe]", 0.9, 2350, True), (rb"[\xa1-\xa3][\xa1-\xfe]", 0.07, 282, True),
               (_EUC, 0.03, 5000, False)],
    "cp1251": [(rb"[\xe0-\xff\xb8]", 0.88, 33, True), (rb"[\xc0-\xdf\xa8]", 0.09, 33, True), (rb"[\x80-\xff]", 0.03, 62, False)],
    "koi8_r": [(rb"[\xc0-\xdf\xa3]", 0.88, 33, True), (rb"[\xe0-\xff\xb3]", 0.09, 33, True), (rb"[\x80-\xff]", 0.03, 62, False)],
    "latin-1": [(rb"[\xdf-\xf6\xf8-\xff]", 0.8, 32, True), (rb"[\xc0-\xd6\xd8-\xde]", 0.1, 30, True),
                (rb"[\xa0-\xbf\x80\x82\x84\x85\x91-\x97]", 0.08, 43, True), (rb"[\x80-\xff]", 0.02, 23, False)],
}
# Logarithm of how much likelier a charset is beforehand: deliveries are Chinese where few characters tell nothing else.
_BEFORE = {"gb18030": 3.0}
# Chance that the letter after another (h: beyond ASCII, a: ASCII) is of the second kind.
_SAME_SCRIPT = {"hh": 0.97, "ha": 0.03, "ah": 0.03, "aa": 0.97}
_FOLLOWS = {"latin-1": {"hh": 0.05, "ha": 0.95, "ah": 0.08, "aa": 0.92}}


def _token(name: str) -> re.Pattern:
    return re.compile(b"|".join([b"([A-Za-z])", b"([\\x00-\\x7f])", *(b"(" + p + b")" for p, *_ in _CLASSES[name])]))


_TOKENS = {name: _token(name) for name in _CLASSES}


def _whole_characters(pieces: Sequence[bytes]) -> list[bytes]:
    """Later pieces from a byte on that ends a character in all charsets: a line end, or else a comma or blank."""
    out = [pieces[0]]
    for p in pieces[1:]:
        m = re.search(rb"\n", p[:4096]) or re.search(rb"[\t ,;]", p)
        out.append(p[m.end():] if m else b"")
    return [p for p in out if p]


def decodes(pieces: Sequence[bytes], charset: str, complete: bool = False) -> bool:
    """Whether a strict decoder takes all pieces, whose last characters may be cut off unless ``complete``."""
    for p in pieces:
        try:
            codecs.getincrementaldecoder(charset)("strict").decode(p, final=complete)
        except UnicodeDecodeError:
            return False
    return True


def _likelihood(pieces: Sequence[bytes], name: str) -> tuple[float, float]:
    """Logarithm of the likelihood, and the share of characters in frequent classes."""
    kinds, pairs = Counter(), Counter()
    for p in pieces:
        last = ""
        for m in _TOKENS[name].finditer(p):
            k = m.lastindex
            now = "a" if k == 1 else "" if k == 2 else "h"
            if now and last:
                pairs[last + now] += 1
            if k > 1:
                kinds[k - 3] += 1
            else:
                kinds[-2] += 1
            last = now
    follows, value, often, all_ = _FOLLOWS.get(name, _SAME_SCRIPT), _BEFORE.get(name, 0.0), 0, 0
    for k, n in kinds.items():
        if k < 0:
            value -= n * math.log(96)
            continue
        _, share, size, frequent = _CLASSES[name][k]
        value += n * math.log(share / size)
        all_ += n
        often += n * frequent
    value += sum(n * math.log(follows[p]) for p, n in pairs.items())
    return value, often / all_ if all_ else 0.0


def guess(pieces: Sequence[bytes], complete: bool = False) -> tuple[str, float]:
    """(charset, confidence) of samples of a file, the first of which is its head; ``complete``: it is all of it."""
    head = pieces[0] if pieces else b""
    for bom, name in BOMS:
        if head.startswith(bom):
            return name, 1.0
    if all(p.isascii() for p in pieces):
        return "utf-8", 1.0
    # a later piece may start inside a character
    trimmed = [head, *(p.lstrip(bytes(range(0x80, 0xc0))) for p in pieces[1:])]
    if decodes(trimmed, "utf-8", complete):
        return "utf-8", 1.0
    pieces = _whole_characters(pieces)
    left = {n: _likelihood(pieces, n) for n in _CLASSES if n == "latin-1" or decodes(pieces, n, complete)}
    best = max(left, key=lambda n: left[n][0])
    share = 1 / sum(math.exp(max(-700.0, v - left[best][0])) for v, _ in left.values())
    if best == "latin-1" and any(re.search(rb"[\x80-\x9f]", p) for p in pieces):
        best, often = "cp1252", left["latin-1"][1]
    else:
        often = left[best][1]
    return best, share * often


def _beyond_ascii(p: bytes) -> int:
    return len(p.translate(None, _ASCII))


def _telling_lines(read: Callable[[int, int], bytes], size: int, step: int) -> bytes:
    """The first lines of a file that are not plain ASCII, of ``SAMPLE`` bytes together."""
    out, total, rest = [], 0, b""
    for at in range(0, size, step):
        data = rest + read(at, step)
        end = len(data) if at + step >= size else data.rfind(b"\n") + 1 or len(data)
        data, rest = data[:end], data[end:]
        if data.isascii():
            continue
        m = _HIGH.search(data)
        while m:
            start, end = data.rfind(b"\n", 0, m.start()) + 1, data.find(b"\n", m.start())
            end = len(data) if end < 0 else end
            out.append(data[start:end] if end - start <= SAMPLE else data[m.start():min(end, m.start() + SAMPLE)])
            total += len(out[-1])
            m = _HIGH.search(data, end)
            if total >= SAMPLE:
                return b"\n".join(out)
    return b"\n".join(out)


def charset_of(read: Callable[[int, int], bytes], size: int, step: int = 4 << 20) -> str:
    """The charset of a file from ``read(offset, bytes)``: of its head and middle, and where these hold under
    ``FEW`` bytes beyond ASCII, of the lines of the whole file that do, found in steps."""
    pieces = [read(0, SAMPLE)]
    if size > 2 * SAMPLE:
        pieces.append(read(size // 2, SAMPLE))
    if size > SAMPLE and not pieces[0].startswith(tuple(b for b, _ in BOMS)) and sum(map(_beyond_ascii, pieces)) < FEW:
        pieces = [_telling_lines(read, size, step)]
    name, confidence = guess(pieces, size <= SAMPLE)
    return name if confidence >= LEAST else "utf-8"
