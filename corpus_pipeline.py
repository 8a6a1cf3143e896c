"""A training-data pipeline over ``documents``: language, toxicity, near copies, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
stage's documents, all but the last with the columns of ``documents``.  Models are fitted on the
documents that reach their stage and on ``labels``.  Every stage's result is written as Parquet to
the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.llm import langid, packing, probminhash, secrets, toxicity
from intakeflow.llm.catalog import tokenizer_path
from intakeflow.llm.common import map_texts, table, written

# Of the posterior over the learned languages: no one of them has a clear share below this.  Gibberish and
# languages that were not learned mostly are above it, so in effect texts without a letter go.
LEAST_SCORE = 0.5

# The stages learn models, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or without a clear language go.  Others stay as they are,
    and so do all with a letter where no language could be learned."""
    model = langid.fit(docs, tokenizer_path("piece_bpe_32k.model"))
    shared = spark.sparkContext.broadcast(model)

    def start():
        def run(texts):
            if not shared.value.languages:
                best = [1.0 if t is not None and langid.has_letter(t) else None for t in texts]
            else:
                best = [None if q is None else float(q.max()) for q in shared.value.posteriors(texts)]
            return {"__score": best, "__text": texts}
        return run

    # the text passes through as a column of its own, since the operator takes it in
    out = map_texts(docs, start, {"__score": "double", "__text": "string"})
    return (out.where(F.col("__score") >= LEAST_SCORE).withColumnRenamed("__text", "text")
            .select(*[f"`{c}`" for c in docs.columns]))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score reaches the operator's threshold go."""
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(field)

    def start():
        def run(texts):
            lists = [(t or "").split() for t in texts]
            value = [0.0] * len(texts) if shared.value is None else shared.value.scores(lists)[0]
            return {"__score": value, "__text": texts}
        return run

    out = map_texts(docs, start, {"__score": "double", "__text": "string"})
    return (out.where(F.col("__score") < toxicity.PREDICT).withColumnRenamed("__text", "text")
            .select(*[f"`{c}`" for c in docs.columns]))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of every group stays, the one with the smallest doc_id.

    Of rows repeated with the same id and text one stays; rows without an id are compared with none
    and stay."""
    kept = probminhash.classes(docs).where("kept and doc_id is not null").groupBy(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("__copies"))
    columns = [f"`{c}`" for c in docs.columns]
    found = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn(
        "__th", F.xxhash64(F.col("text").cast("string"))).join(kept, ["__id", "__th"])
    single = found.where("__copies = 1").select(*columns)
    repeated = found.where("__copies > 1").dropDuplicates(["__id", "__th"]).select(*columns)
    return single.unionByName(repeated).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark, and n_chars follows the text."""
    return secrets.redact(docs, secrets.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the token pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("toxicity", toxic), ("MinHash near-dedup", near_copies),
          ("secret scans", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
