import corpus_pipeline as C
from intakeflow.llm import common, probminhash, secrets


def test_stages(spark, awkward):
    assert [n for n, _ in C.STAGES] == ["language ID", "toxicity", "MinHash near-dedup", "secret scans", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").unionByName(awkward.selectExpr(
        "doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars"))
    for name, stage in C.STAGES[:-1]:
        before = docs.columns
        docs = common.written(stage(spark, docs, sf), "t")
        assert docs.columns == before, name
        rows = docs.collect()
        if name == "language ID":  # null, empty, blank and letterless texts go, nothing else
            assert {10200, 10201, 10202, 10203}.isdisjoint(r.doc_id for r in rows)
            assert len(rows) == 200 + awkward.count() - 4
        if name == "MinHash near-dedup":
            assert not any(r.doc_id in (10204, 10205) for r in rows) and any(r.doc_id == 10000 for r in rows)
            kept = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(kept) == len(set(kept))
            left = probminhash.classes(docs).where("not kept").count()
            assert left == 0
        if name == "secret scans":
            assert not any(secrets.Texts([r.text]).base()[0] for r in rows)
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_extra_columns_and_empty(spark, empty_docs):
    sf = "/root/testdata/sf0.001"
    docs = empty_docs.selectExpr("*", "1 as score", "2 as kept", "3 as th", "4 as copies")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*empty_docs.columns, "score", "kept", "th", "copies"] and docs.count() == 0
    assert C.STAGES[-1][1](spark, docs, sf).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in common.components(df, "t").collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert got == want
    assert common.components(df.limit(0), "t").count() == 0


def test_no_language_learned_keeps_documents(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, "en")],
                                 "doc_id long, text string, lang string")
    assert [r.doc_id for r in C.language(spark, docs, "").collect()] == [1]
