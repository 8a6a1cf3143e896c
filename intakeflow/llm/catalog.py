"""Registry of the corpus queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}


def register(fn: QueryFn) -> QueryFn:
    _QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """A public tokeniser's file; the default folder is that of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(mod: int):
    """crc32 of the decimal doc_id, modulo ``mod`` (null doc_id: null)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by segmentation-marginalised unigrams, learned from the rows whose
    crc32(doc_id) mod 5 is not 0.  A row without doc_id is neither learned from nor held out."""
    from intakeflow.llm import langid

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "text", "lang")
    model = langid.fit(docs.where(remainder(5) != 0), tokenizer_path("piece_bpe_32k.model"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model)


@register
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids by a max-plus scan, and the CRC-32 of the text decoded from them."""
    from intakeflow.llm import pieces

    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), path)
    decoded = pieces.decode(encoded.withColumn("tokens", F.col("ids")), path)
    return decoded.select("doc_id", "part", "parts", "n_tokens", F.col("tokens").alias("ids"),
                          F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a conditional random field, learned from labelled rows whose
    crc32(doc_id) mod 3 is not 1.  A row without doc_id is neither learned from nor held out."""
    from intakeflow.llm import toxicity

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(remainder(3) != 1)
    return toxicity.score(docs, toxicity.fit(docs, labels))


@register
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes by vector bin packing of groups of equal texts."""
    from intakeflow.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"))


@register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and a character network over all other candidates."""
    from intakeflow.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs))


@register
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20, by vantage-point trees."""
    from intakeflow.llm import vptree

    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@register
def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95 or more, by dual traversal of cover trees."""
    from intakeflow.llm import covertree

    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@register
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 2048 ids by Karmarkar-Karp differencing."""
    from intakeflow.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@register
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (five-word shingles, similarity 0.8) by ProbMinHash."""
    from intakeflow.llm import probminhash

    return probminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@register
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by a bidirectional LSTM over its blocks."""
    from intakeflow.llm import htmltext

    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


@register
def op11_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors around 40 centroids in five exact rounds, with bounds from a LAESA pivot table."""
    from intakeflow.llm import pivotclusters

    return pivotclusters.clusters(table(spark, sf_dir, "embeddings"))


@register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two and three words of every language, counted in HAT-tries."""
    from intakeflow.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


@register
def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the budgeted windows of all conversations and of one whose texts are control strings."""
    from intakeflow.llm import chatformat

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chatformat.digests(chatformat.windows(rows, tokenizer_path("word_bpe_49k.json")))


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from intakeflow.llm import collocations, pivotclusters

    return {"op11_pivot_clusters": pivotclusters.oracle(), "op12_collocations": collocations.oracle()}
