import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intakeflow.sources import splitjson
from intakeflow.sources.readers import _json_items, json_skips, read_json

TEXT = st.text(alphabet='ab{}[]",:\\\\ \\né', max_size=6)
LEAF = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), TEXT)
VALUE = st.recursive(LEAF, lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(TEXT, v, max_size=4)), max_leaves=12)
ROWS = st.lists(st.one_of(VALUE, st.dictionaries(st.sampled_from(["id", "x}", "y"]), VALUE, max_size=3)), max_size=6)
WAYS = [[], ["data"], ["a}b", "rows"]]


def whole(text, parts):
    """Items of the array at a path, by the standard library's parser; None: does not parse."""
    try:
        value = splitjson._DECODER.decode(text.strip(" \t\n\r"))
    except ValueError:
        return None
    for p in parts:
        value = value.get(p) if isinstance(value, dict) else None
    return value if isinstance(value, list) else []


def ranged(text, parts, cuts):
    """Items found range by range, as the Spark passes do; None: does not parse, "piece": key over a border."""
    data = text.encode()
    if not data:
        return None
    lines = data.split(b"}")
    if not lines[-1]:
        lines.pop()
    at = sorted({0, *[c for c in cuts if c < len(lines)], len(lines)})
    rows, ranges = [], []
    for s, e in zip(at, at[1:]):
        piece = b"}".join(lines[s:e])
        ranges.append((s, piece, e == len(lines)))
        scan = splitjson.Scan(piece if e == len(lines) else piece + b"}")
        rows.append({"at": s, "bytes": len(piece) + 1, "size": len(data),
                     **{k: json.dumps(scan.effect(x)) for k, x in (("outside", False), ("inside", True))}})
    plan = splitjson.Plan()
    plan.add("f", rows, len(parts) + 1)
    if "f" in plan.single:
        return "piece"
    if "f" in plan.bad:
        return None
    out, open_, asked = [], None, None
    try:
        for s, piece, ends in ranges:
            cutter = splitjson.Cutter(parts, *plan.state["f", s], s == 0)
            got = cutter.feed(piece + b"}" * (not ends or plan.brace["f"]))
            if ends:
                got += cutter.last()
            if cutter.head:
                open_ += b"".join(cutter.head)
                if not cutter.skip or ends:
                    out += asked.parse(open_, 0)
                    if ends and cutter.skip and asked.phase != "done":
                        return None
            out += got
            if not cutter.skip:
                open_, asked = b"".join(cutter.rest), cutter
    except LookupError:
        return "piece"
    except splitjson.FAULTS:
        return None
    return [splitjson._DECODER.decode(x) for _, x in out]


@settings(max_examples=400, deadline=None)
@given(ROWS, VALUE, st.sampled_from(WAYS), st.lists(st.integers(0, 40), max_size=5), st.sampled_from([None, 1]),
       st.one_of(st.none(), st.tuples(st.integers(0, 200), st.sampled_from(["", "}", "]", ",", '"', "{", "x"]))))
def test_ranges_hold_the_items_of_the_whole(rows, other, parts, cuts, indent, damage):
    """Any cut into ranges gives the items of the whole document, or finds that it does not parse."""
    value = rows
    for p in reversed(parts):
        value = {"before": other, p: value, "z": [other, {"data": rows}]}
    text = json.dumps(value, indent=indent, ensure_ascii=False) + "\n" * (indent or 0)
    if damage:
        i = damage[0] % (len(text) + 1)
        text = text[:i] + damage[1] + text[i + 1:]
    got = ranged(text, parts, cuts)
    if got != "piece":  # then the document is read in one piece
        assert got == whole(text, parts)
    cutter = splitjson.Cutter(parts)
    try:
        alone = [splitjson._DECODER.decode(x) for _, x in cutter.feed(text.encode()) + cutter.last()]
    except splitjson.FAULTS:
        alone = None
    assert alone == whole(text, parts)


@given(st.lists(st.sampled_from([b"{", b"[", b"]", b"}", b'"', b'"k":', b",", b" ", b'\\\\"']), max_size=30),
       st.lists(st.integers(0, 30), min_size=2, max_size=2))
def test_effects_combine(some, cuts):
    a, b = sorted(c % (len(some) + 1) for c in cuts)
    x, y, z = (b"".join(s) for s in (some[:a], some[a:b], some[b:]))

    def effect(data, inside):
        return splitjson.Scan(data).effect(inside)

    for inside in (False, True):
        first = effect(x, inside)
        second = effect(y, first[0])
        third = effect(z, second[0])
        left = splitjson.combine(splitjson.combine(first, second), third)
        assert left == splitjson.combine(first, splitjson.combine(second, third))
        one = effect(x + y + z, inside)
        assert (left[0], left[1], [k for k, _ in left[2]]) == (one[0], one[1], [k for k, _ in one[2]])


def small_ranges(spark, n=9000):
    keys = {"spark.sql.files.maxPartitionBytes": str(n), "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    return before


def test_large_documents(spark, tmp_path):
    """Documents of many ranges: one whole, one with giant items, damaged ones, a key over a border, small ones."""
    rows = [{"id": i, "t": 'a } "b" \\ { [' * (i % 5), "n": {"k": [1, {"z": 2.50}], "e": {}}} for i in range(600)]
    good = {"meta": [{"data": [{"id": -1}]}, "}"], "data": rows, "note": "}{" * 5000, "end": {"data": [{"id": -2}]}}
    giant = {"data": [{"id": 1000, "t": "}" * 20_000}, {"id": 1001, "n": {"k": [{"z": "]"}] * 900}}, {"id": 1002}]}
    text = json.dumps(good)
    docs = {"good": text, "giant": json.dumps(giant, indent=1), "cut": text[:-200], "comma": text.replace("}, {", "} {", 1),
            "tail": text + " x", "late": text.replace('"id": 580', '"id": 58O'), "blank": " " * 9000 + "}" * 0,
            "key": json.dumps({"}" * 12_000: {"id": 0}, "data": [{"id": 2000}]}), "none": '{"other": [{"id": 7}]}',
            "small": '\ufeff{"data": [{"id": 3000, "only": true}, null]}\n', "bad": '{"data": [{"id": 1}]'}
    for name, doc in docs.items():
        (tmp_path / f"{name} +.json").write_text(doc, encoding="utf-8")
    before = small_ranges(spark)
    try:
        df = read_json(spark, str(tmp_path), "data.item")
        got = {}
        for r in df.orderBy("_row").collect():
            got.setdefault(r["_file"].split("/")[-1].split(" ")[0], []).append(r)
        skipped = {r["_file"].split("/")[-1].split(" ")[0] for r in json_skips(spark, str(tmp_path), "data.item").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert skipped == {"cut", "comma", "tail", "late", "blank", "bad"}
    assert set(got) == {"good", "giant", "key", "small"}
    assert [(r.id, r.t) for r in got["good"]] == [(str(x["id"]), x["t"]) for x in rows]
    assert got["good"][7].n.k == "[1,{\"z\":2.50}]" or got["good"][7].n.k[0] == "1"
    assert [(r.id, r.t and len(r.t)) for r in got["giant"]] == [("1000", 20_000), ("1001", None), ("1002", None)]
    assert [r.id for r in got["key"]] == ["2000"]
    assert [(r.id, r.only) for r in got["small"]] == [("3000", "true"), (None, None)]
    assert len({r["_row"] for r in got["good"]}) == 600


def test_columns_as_the_built_in_reader_finds_them(spark, tmp_path):
    rows = [{"b": 1, "a": None, "o": {"x": [1, None], "e": {}}, "l": []}, {"b": "t", "o": {"y": {"z": False}}, "m": 1},
            {"m": {"q": 1}, "l": [[1], []]}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    want = spark.read.option("multiLine", True).option("primitivesAsString", True).json(str(tmp_path)).schema
    got = read_json(spark, str(tmp_path)).drop("_file", "_row")
    assert got.schema.simpleString() == want.simpleString()
    assert read_json(spark, str(tmp_path), schema=got.select("b").schema).orderBy("_row").select("b").collect() \
        == got.select("b").collect()
    assert got.select(F.col("o.x")).first().x == ["1", None]


def test_ranges_are_read_in_the_tasks(spark, tmp_path, monkeypatch):
    """tasks get ranges, not the pieces between braces, and find what Spark's text source finds."""
    note = "{\"[\\\\\n\\}é"
    rows = [{"k": i, "note": note * (i % 3), "parts": [{"q": 1.5}]} for i in range(900)]
    (tmp_path / "compact.json").write_text(json.dumps({"a": "}", "data": rows}, separators=(",", ":")))
    (tmp_path / "wide.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"data": [7, *rows, [1]]}, ensure_ascii=False, indent=1).encode() + b"\n")
    (tmp_path / "cut short.json").write_text(json.dumps({"data": rows})[:-2])
    (tmp_path / "one bad item.json").write_text(json.dumps({"data": rows}).replace('{"k": 800,', '{"k": 800,,', 1))
    (tmp_path / "small.json").write_text('{"data": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "numbers.json").write_text(json.dumps({"data": list(range(20000))}))  # no brace but at its ends
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def found():
        items, bad = _json_items(spark, str(tmp_path), "data.item", False)
        return (sorted((r["file"], r["row"], r["item"]) for r in items.where("fault is null").collect()),
                sorted(r["_file"] for r in json_skips(spark, str(tmp_path), "data.item").collect()))

    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "40000")
        assert splitjson.pieces(spark, [str(tmp_path)], False).count() < 100
        (items, skips) = found()
        (tmp_path / "numbers.json").unlink()
        monkeypatch.setattr(splitjson, "can_read_ranges", lambda path: False)
        (pieces, same) = found()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    names = lambda rows: [(f.rsplit("/", 1)[1], json.loads(x)) for f, _, x in rows]
    got = names(items)
    assert [x for f, x in got if f == "compact.json"] == rows and [x for f, x in got if f == "wide.json"] == [7, *rows, [1]]
    assert [x for f, x in got if f == "numbers.json"] == list(range(20000))
    assert [f.rsplit("/", 1)[1] for f in skips] == ["cut short.json", "one bad item.json"] == [f.rsplit("/", 1)[1] for f in same]
    assert names(pieces) == [x for x in got if x[0] != "numbers.json"]
