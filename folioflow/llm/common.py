"""Shared pieces: reading tables, cutting lineage, range placement and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session names none, a folder of the warehouse, or on a
    local master a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/folioflow-scratch"
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
    return spark.sparkContext.getCheckpointDir()


def own_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and outlives executors. A table is deleted as soon as
    no later step reads it; what a lazy result still reads stays."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder = spark, own_folder(spark, kind)

    def write(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder, computed once."""
    return Scratch(df.sparkSession, "cut").write("table", df)


def text_key() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text")


#: Rows of a batch that stand in memory as Python's values at once.
HELD = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in slices of HELD. Spark's batches have up to 10,000 rows, and memory that a worker once took for
    their strings stays with it through later stages."""
    for b in batches:
        for at in range(0, b.num_rows, HELD):
            yield b.slice(at, HELD)


def as_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, whatever their names), i (doc_id), k (text_key); "row.*" gives docs again."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("i"), text_key().alias("k"))


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_starts(df: DataFrame, key: str, n: int) -> list[int]:
    """The smallest key of each of about n ranges of equal row counts (a list as long as the number of ranges).

    Reads only the key column. The driver gets one number a range, never rows."""
    probs = [i / n for i in range(1, n)]
    cuts = sorted(set(df.stat.approxQuantile(key, probs, 1 / (4 * n)))) if n > 1 else []
    bucket = bucket_of(F.col(key), [int(c) for c in cuts])
    rows = df.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.min(key).alias("m")).collect()
    return sorted(r["m"] for r in rows)


def bucket_of(key, starts: list[int]):
    """Index of the range that holds the key: how many starts, but the first, are not above it."""
    if not starts:
        return F.lit(0)
    edges = F.array(*[F.lit(int(s)) for s in starts])
    return F.greatest(F.lit(0), F.aggregate(edges, F.lit(0), lambda n, s: n + (s <= key).cast("int")))


_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_STEP = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_CHUNK = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


_POWERS = [_powers(_STEP, _CHUNK), _powers(_BACK, _CHUNK)]


def hashed_words(text: str | None, letters: bytes = _PLAIN) -> np.ndarray:
    """64-bit hashes of a text's words, in order. `letters` maps bytes to bytes; blanks part words. By default words stand
    between the ASCII white space characters, A-Z in lower case.

    A word's hash is its polynomial over the bytes, taken from running sums over the text, then mixed. Texts
    are cut at blanks into chunks, so memory is bounded but for a single word's length."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(letters)
    out = []
    at = 0
    while at < len(data):
        stop = len(data) if len(data) - at <= _CHUNK else data.rfind(b" ", at, at + _CHUNK) + 1
        if stop <= at:  # one word longer than a chunk
            stop = data.find(b" ", at) + 1 or len(data)
        part = np.frombuffer(data, np.uint8, stop - at, at)
        if len(part) > len(_POWERS[0]):
            _POWERS[:] = [_powers(_STEP, len(part)), _powers(_BACK, len(part))]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], part != 32, [False]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((part + np.uint64(1)) * _POWERS[0][: len(part)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * _POWERS[1][starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; a shorter text is one run; no words, no runs."""
    n = len(h)
    if n == 0:
        return h
    out = np.zeros(max(1, n - width + 1), np.uint64)
    for i in range(min(width, n)):
        out = (out ^ (h[i : i + len(out)] * _P[i % 5])) * _P[(i + 1) % 5]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def in_order(df: DataFrame, key: str, then: list[str], starts: list[int], heads: bool = False) -> DataFrame:
    """Rows dealt out by ranges of `key` (partition i holds range i) and sorted in each; rows without a key come first.

    With heads, the first row of every range also goes, flagged `head`, to the end of the range before it (that of
    the first range to the end of the last), so each row meets its successor. `starts` is from range_starts: as many
    numbers as ranges. The order inside a range is (key, then...)."""
    n = max(1, len(starts))
    edges = np.array(starts[1:], np.int64)
    firsts = np.array(starts, np.int64)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        empty = ids.isna().to_numpy()
        v = ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
        b = np.searchsorted(edges, v, side="right")
        first = heads & ((np.searchsorted(firsts, v, side="right") - 1 == b) & np.isin(v, firsts) | empty)
        return pd.Series([[int(x), -1 - int((x - 1) % n)] if f else [int(x)] for x, f in zip(b, first)])

    at = F.explode(places(F.col(key).cast("long")))
    placed = df.withColumn("_at", at).withColumn("head", F.col("_at") < 0)
    placed = placed.withColumn("_at", F.when(F.col("head"), -1 - F.col("_at")).otherwise(F.col("_at")))
    return placed.repartitionById(n, F.col("_at")).sortWithinPartitions("head", F.col(key).asc_nulls_first(), *then)
