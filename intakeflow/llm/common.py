"""Helpers shared by the corpus operators: tables, written intermediates, word caches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from intakeflow.session import scratch_path

# Documents per Arrow batch: bounds a Python worker's memory when texts are long.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(df: DataFrame, fn: Callable[[], Callable[[list], dict]], new: dict[str, str],
              text: str = "text") -> DataFrame:
    """Replace the column ``text`` by what is computed of whole texts, batch by batch (Arrow).

    ``fn()`` is called once per task and returns a function from a list of texts (None: null) to
    ``{column: values}`` for the columns ``new`` (name -> SQL type).  All other columns pass through
    as they are; those called like a new one are left out.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text and c not in new]
    df = df.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").cast("string").alias(text))
    fields = [df.schema[c] for c in kept]
    fields += StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in new.items())).fields
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[len(kept):]]
        compute = fn()
        for b in batches:
            got = compute(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], *(pa.array(got[c], t) for c, t in zip(new, types))], names=schema.names)

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return memory that Python has freed to the system, where the C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class WordCache:
    """word -> value for the words seen lately.

    Past ``BYTES`` bytes all are forgotten, which bounds memory and changes no result.  A Python worker
    serves one operator after another and holds the words of the last one only.  Words of over ``LONG``
    characters are not kept.
    """

    LONG = 200
    BYTES = 96 << 20
    ENTRY = 150  # bytes of an entry besides its word's characters and its value's bytes

    _last: WordCache | None = None

    def __init__(self, fill: Callable[[list[str]], Iterable]):
        self.known: dict = {}
        self.fill, self.bytes = fill, 0

    def __getstate__(self):
        return {"fill": self.fill, "known": {}, "bytes": 0}

    def _start(self) -> None:
        last = WordCache._last
        if last is not self:
            if last is not None:
                last._forget()
            WordCache._last = self

    def _forget(self) -> None:
        self.known = {}
        self.bytes = 0
        _give_back()

    def _keep(self, got: dict) -> None:
        if self.bytes > self.BYTES:
            self._forget()
        some = got if max(map(len, got)) <= self.LONG else {w: v for w, v in got.items() if len(w) <= self.LONG}
        self.known.update(some)
        self.bytes += sum(map(len, some)) + sum(map(len, some.values())) + self.ENTRY * len(some)

    def look_up(self, lists: Iterable[list[str]]) -> Iterator[list]:
        """The values (bytes or lists) of every list of words, one list at a time."""
        self._start()
        for words in lists:
            values = list(map(self.known.get, words))
            if None in values:
                at = [i for i, v in enumerate(values) if v is None]
                new = list({words[i] for i in at})
                got = dict(zip(new, self.fill(new)))
                for i in at:
                    values[i] = got[words[i]]
                self._keep(got)
            yield values

    def look_up_together(self, lists: list[list[str]]) -> Iterator[list]:
        """As ``look_up``, with one call of ``fill`` for all lists."""
        self._start()
        values = [list(map(self.known.get, words)) for words in lists]
        new = list({w for words, v in zip(lists, values) if None in v for w, x in zip(words, v) if x is None})
        if new:
            got = dict(zip(new, self.fill(new)))
            for words, v in zip(lists, values):
                if None in v:
                    v[:] = [got[w] if x is None else x for w, x in zip(words, v)]
            self._keep(got)
        yield from values


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list ``(a long, b long)`` -> ``(id, component)``.

    ``component`` is the smallest id reachable.  Alternating large-star and small-star
    steps (Kiveris et al. 2014): every round links each vertex to the smallest vertex of
    its neighbourhood with map-side combined minima, so a vertex with many edges is never
    gathered in one task, and the rounds grow with the logarithm of the diameter.  Every
    round is a written table.  Self loops and repeated edges are allowed; vertices without
    an edge do not appear.
    """
    def both(e):
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def checksum(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                name)
    state = checksum(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: neighbours above u go to the smallest of u's neighbourhood
        sym = both(e)
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = (sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: neighbours at or below u, and u itself, go to the smallest of them
        e = e.where("a <> b")
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        e = written(e, name)
        now = checksum(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id")).distinct()
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(roots.withColumn("component", F.col("id"))))
