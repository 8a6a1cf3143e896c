from intakeflow.llm.common import WordCache


def test_cache_is_bounded_in_bytes_and_by_operator(monkeypatch):
    monkeypatch.setattr(WordCache, "BYTES", 5_000)
    first = WordCache(lambda ws: (w.upper().encode() for w in ws))
    for k in range(50):
        words = [f"w{k}-{i}" for i in range(20)] + ["x" * 300]
        assert next(first.look_up([words])) == [w.upper().encode() for w in words]
        assert len(first.known) < 60 and "x" * 300 not in first.known
    other = WordCache(lambda ws: (w.encode() for w in ws))
    assert list(other.look_up_together([["a", "b"], [], ["b"]])) == [[b"a", b"b"], [], [b"b"]]
    assert not first.known and first.bytes == 0 and len(other.known) == 2
    assert next(first.look_up([["a"]])) == [b"A"] and not other.known
