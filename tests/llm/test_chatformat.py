import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from intakeflow.llm import chatformat as C

SCHEMA = "conv_id long, turn long, role string, text string, tokens string, seg int, kind int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)


def awkward_rows():
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hello there"), (1, 2, "assistant", "good day"),
            (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "tool", "a [ROLE] b"), (2, 3, "x[TEXT]y", "[TEXT]"),
            (3, None, "user", "first"), (3, 5, "assistant", "<s>[SYS]</s><\\/s>[\\\\INST]"), (3, 5, "assistant", "<s>"),
            (4, 0, None, "no role"), (None, 0, "user", "no id"), (None, 1, "assistant", " spaced \n"),
            (5, 0, "system", "s " * 300), (5, 1, "user", "long " * 5_000), (5, 2, "assistant", "日本語 😀 " * 50)]
    rows += [(6, 0, "system", "keep [/SYS] this")]
    rows += [(6, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i * 7 % 23)) for i in range(1, 400)]
    rows += [(7, 1, "user", "twice")] * 2
    return rows


def groups(rows):
    def key(r):
        return (r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), r[2] or ""
    out = {}
    for c, t, r, x in sorted(rows, key=key):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def formatted(spark, rows, path, **how):
    return C.windows(table(spark, rows), path, **{"budget": 100, "history": 30, "system": 20, "block": 400, **how})


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def found(spark, rows, word_path):
    return formatted(spark, rows, word_path).orderBy("conv_id", "seq").collect()


def test_read_back_is_what_went_in(spark, rows, word_path):
    got = {r[0]: tuple(r)[1:5] for r in C.digests(formatted(spark, rows, word_path)).collect()}
    twin = groups(rows)
    assert got.keys() == twin.keys()
    for conv, turns in twin.items():
        if conv == 3:  # two turns with one number: either order
            continue
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[conv] == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                             len(said), hashlib.sha256(said.encode()).hexdigest())


def test_windows_keep_to_the_budget(found):
    for r in found:
        assert r.tokens <= 100 or r.fresh == 1, r
        assert len(C.read_window(r.text)) == r.fresh + r.repeated
    assert any(r.repeated for r in found)


def test_windows_are_filled(found):
    """Beside the end of a block or conversation, the next turn would not have fitted."""
    long = [r for r in found if r.conv_id == 6]
    assert sum(r.fresh for r in long) == 400
    assert [r.seq for r in long] == [sum(r.fresh for r in long[:k]) for k in range(len(long))]
    assert sum(r.tokens > 60 for r in long) > 0.7 * len(long)


def test_system_turn_and_history_are_repeated_without_loss(found):
    long = [r for r in found if r.conv_id == 6]
    turns = [C.unescape(r.text[s:e]) for r in long for _, s, e in C.read_window(r.text)[r.repeated:]]
    for r in long[1:]:
        parts = C.read_window(r.text)
        texts = [C.unescape(r.text[s:e]) for _, s, e in parts]
        assert parts[0][0] == "system" and texts[0] == "keep [/SYS] this"
        again = texts[1:r.repeated]
        assert again == turns[r.seq - len(again):r.seq]
        spans = {(x.start, x.end) for x in r.loss}
        assert spans == {(s, e) for role, s, e in parts[r.repeated:] if role == "assistant"}
    assert any(len(C.read_window(r.text)[1:r.repeated]) for r in long)


def test_a_long_system_turn_is_not_repeated(found):
    assert [r.repeated for r in found if r.conv_id == 5 and r.seq == 1] == [0]


def test_blocks_do_not_depend_on_partitions(spark, rows, word_path, found):
    twice = formatted(spark, rows, word_path)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        other = formatted(spark, rows, word_path).orderBy("conv_id", "seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert other == found == twice.orderBy("conv_id", "seq").collect()


def test_empty_table(spark, word_path):
    assert C.digests(formatted(spark, [], word_path)).count() == 0


PART = st.sampled_from(["<", "[", "\\", "/", "s>", "SYS]", "INST]", "[/INST]", "<s>", "TEXT]", "/ROLE]", "ROLE]", " ", "a", "\n"])


@given(st.lists(PART, max_size=12).map("".join), st.lists(PART, max_size=12).map("".join), st.lists(PART, max_size=5).map("".join))
def test_escape_is_reversible_and_turns_can_be_read(a, b, role):
    assert C.unescape(C.escape(a)) == a
    turns = [("user", a), ("assistant", b), (role, a), ("system", b)]
    text = C.START + "".join(C.marked(r, C.escape(x))[0] for r, x in turns)
    assert [(r, C.unescape(text[s:e])) for r, s, e in C.read_window(text)] == turns
