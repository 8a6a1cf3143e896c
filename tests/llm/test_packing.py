import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from intakeflow.llm import packing


def whole(path, text):
    from tokenizers import Tokenizer
    return np.asarray(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [packing.EOS], "<u4")


PARTS = st.sampled_from([" ", "\n", "\t", "\xa0", "\x1c", ".", ",", "'s", "'ll", "the", "Hello", "ÀÉ", "ß", "İ", "Σ", "~", "12", "²",
                         "<|endoftext|>", "<|", "é", "日本", "😀", "ſ", "don't", "...", "x,", "y."])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_word_ids_equal_those_of_the_whole_text(text):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    assert next(packing.ids_of([text], path)) == whole(path, text).tobytes()


def test_words_of_documents(spark, word_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t, got in zip(texts, packing.ids_of(texts, word_path)):
        assert got == whole(word_path, t or "").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(1, 9))
def test_difference_is_a_partition(sizes, k):
    got = packing.difference(sizes, k)
    assert len(got) == k and sorted(i for w in got for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in got]
    assert max(sums) - min(sums) <= max(sizes)


def test_karmarkar_karp_example():
    got = [sum((8, 7, 6, 5, 4)[i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)]
    assert sorted(got) == [14, 16]  # the known outcome of largest differencing
    assert all(sum(w) <= 10 for w in ([[6, 6, 6][i] for i in w] for w in packing.divide([6, 6, 6], 10)))


def test_pack_awkward_rows(awkward, empty_docs, word_path):
    rows = packing.pack(awkward, word_path, group_windows=2).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, []).append(whole(word_path, r.text or ""))
    parts = {}
    windows = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(parts) == set(texts)
    for i, some in texts.items():  # every id of every copy lies in exactly one piece
        want = sorted((s, e - s, len(t)) for t in some for s, e in cuts(len(t)))
        assert sorted((s, n, total) for s, n, _, total in parts[i]) == want
        for s, n, crc, total in parts[i]:
            assert any(len(t) == total and zlib.crc32(t[s:s + n].tobytes()) == crc for t in some)
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack(empty_docs, word_path).count() == 0


def cuts(n):
    full = n - n % packing.CAPACITY
    at = [*range(0, full, packing.CAPACITY), *range(full, n, packing.ITEM), n]
    return zip(at, at[1:])


def test_padding_is_small(spark, word_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, word_path).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in rows) > 0.99 * packing.CAPACITY * len(rows)
