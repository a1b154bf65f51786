"""Operator 11: hard negatives of anchors, by sorting each anchor's scores whole and searching every positive's limits in them.

Anchors in groups and rows in shares make a grid. A cell's task holds its anchors and reads its share in blocks; for each
block an anchor's scores are sorted by score and id, and what it keeps is merged with what it kept before. So a task's
memory is bounded by GROUP and BLOCK, whatever the table's size, and no label, source or vector makes a cell larger."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, partitions_for, table

#: Anchors in a cell, rows in a cell, rows that a task holds at once, anchors whose scores it holds at once.
GROUP, SHARE, BLOCK, TILE = 1 << 15, 1 << 20, 1 << 12, 128
#: Stands for no score. Scores beyond the range of long are held to it.
NONE, LEAST, MOST = -(2**63) + 1, -(2**63) + 2, 2**63 - 1


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q: rows that take part, each component x as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v * scale))
    return vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Vectors:
    """The columns of some rows as arrays, in the order of vec_id, rows without one last."""

    def __init__(self, part, kind: type):
        of = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        lacking = part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        ids = part.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, lacking))
        self.id, self.lacking = ids[order], lacking[order]
        self.label, self.rid, self.q = of("label")[order], of("rid")[order], _matrix(part.column("q"))[order].astype(kind)
        self.order = order

    def scores(self, rows: Vectors, tile: slice) -> np.ndarray:
        d = min(self.q.shape[1], rows.q.shape[1])
        if not d:
            return np.zeros((len(self.id[tile]), len(rows.id)), np.int64)
        s = self.q[tile, :d] @ rows.q[:, :d].T
        return np.clip(s, LEAST, MOST).astype(np.int64) if s.dtype == object else s.astype(np.int64)


class Best:
    """The first k of the scores met so far, by score descending, then id, rows without id last."""

    def __init__(self, *shape: int):
        self.score, self.id, self.lacking = np.full(shape, NONE, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)

    def merge(self, tile: slice, new: Best) -> None:
        k = self.score.shape[-1]
        score, id_, lacking = (np.concatenate([getattr(self, c)[tile], getattr(new, c)], -1) for c in ("score", "id", "lacking"))
        order = np.lexsort((id_, lacking, -score), axis=-1)[..., :k]
        self.score[tile], self.id[tile], self.lacking[tile] = (np.take_along_axis(x, order, -1) for x in (score, id_, lacking))

    def put(self, at: tuple, rows: Vectors, cols: np.ndarray, scores: np.ndarray) -> None:
        self.score[at], self.id[at], self.lacking[at] = scores, rows.id[cols], rows.lacking[cols]


class Positives:
    """The first k other rows of each anchor's label."""

    SCHEMA = "rid long, score long, id long"

    def __init__(self, anchors: pa.RecordBatch, kind: type, k: int):
        self.kind, self.anchors = kind, Vectors(anchors, kind)
        self.best = Best(len(self.anchors.id), k)

    def meet(self, part: pa.RecordBatch) -> None:
        rows, own, k = Vectors(part, self.kind), self.anchors, self.best.score.shape[1]
        for at in range(0, len(own.id), TILE):
            tile = slice(at, at + TILE)
            s = own.scores(rows, tile)
            order = np.argsort(-s, axis=1, kind="stable")  # rows stand by id, so this sorts by score and id
            fits = (rows.label[order] == own.label[tile, None]) & (rows.rid[order] != own.rid[tile, None])
            nth = fits.cumsum(1)
            r, c = np.nonzero(fits & (nth <= k))
            new = Best(len(s), k)
            new.put((r, nth[r, c] - 1), rows, order[r, c], s[r, order[r, c]])
            self.best.merge(tile, new)

    def told(self) -> pa.RecordBatch:
        at = self.best.score != NONE
        ids = pa.array(self.best.id[at], pa.int64(), mask=self.best.lacking[at])
        return pa.RecordBatch.from_arrays([pa.array(self.anchors.rid[np.nonzero(at)[0]]), pa.array(self.best.score[at]), ids], ["rid", "score", "id"])


class Negatives:
    """For each anchor and positive the first k rows of other labels whose score lies between the positive's limits."""

    SCHEMA = "rid long, n int, score long, id long"

    def __init__(self, anchors: pa.RecordBatch, kind: type, k: int, lower: int, upper: int):
        self.kind, self.k, self.anchors = kind, k, Vectors(anchors, kind)
        scores = anchors.column("positives").to_pylist()
        scores = [scores[i] for i in self.anchors.order]
        held = lambda x: min(max(x, LEAST), MOST)
        self.lowest = [np.array([held(-(-lower * p // 100)) for p in ps], np.int64) for ps in scores]
        self.highest = [np.array([held(upper * p // 100) for p in ps], np.int64) for ps in scores]
        self.best = Best(len(scores), max(map(len, scores), default=0), k)

    def meet(self, part: pa.RecordBatch) -> None:
        rows, own = Vectors(part, self.kind), self.anchors
        for at in range(0, len(own.id), TILE):
            tile = slice(at, at + TILE)
            s = own.scores(rows, tile)
            order = np.argsort(-s, axis=1, kind="stable")  # as above
            new = Best(len(s), *self.best.score.shape[1:])
            for i, by in enumerate(order):
                down = -s[i, by]
                others = np.flatnonzero(rows.label[by] != own.label[at + i])
                starts = np.searchsorted(others, np.searchsorted(down, -self.highest[at + i], "left"))
                ends = np.searchsorted(others, np.searchsorted(down, -self.lowest[at + i], "right"))
                for n, (a, b) in enumerate(zip(starts, ends)):
                    if a < b:
                        cols = by[others[a : min(b, a + self.k)]]
                        new.put((i, n, slice(0, len(cols))), rows, cols, s[i, cols])
            self.best.merge(tile, new)

    def told(self) -> pa.RecordBatch:
        at = self.best.score != NONE
        r, n, _ = np.nonzero(at)
        ids = pa.array(self.best.id[at], pa.int64(), mask=self.best.lacking[at])
        return pa.RecordBatch.from_arrays([pa.array(self.anchors.rid[r]), pa.array(n.astype(np.int32)), pa.array(self.best.score[at]), ids], ["rid", "n", "score", "id"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Runs of rows of one cell and kind, of at most BLOCK rows."""
    for batch in batches:
        cell, is_row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "is_row"))
        edges = np.flatnonzero((np.diff(cell) != 0) | (is_row[1:] != is_row[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(cell)]):
            for at in range(a, b, BLOCK):
                yield cell[at], is_row[at], batch.slice(at, min(BLOCK, b - at))


def _per_cell(make: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads each cell's anchors, which come first, then its rows in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(_parts(batches), key=lambda p: p[0]):
            anchors, found = [], None
            for _, is_row, part in parts:
                if not is_row:
                    anchors.append(part)
                elif anchors:
                    found = found or make(pa.concat_batches(anchors))
                    found.meet(part)
            if found:
                yield found.told()

    return run


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, label, embedding).

    anchor tells from vec_id and label which rows are anchors. A score is the inner product of floor(scale * x); higher ones come
    first, ties by smaller vec_id. An anchor's positives are its first `positives` other rows of its label; each gets the first
    `negatives` rows of other labels with lower * positive_score <= 100 * negative_score <= upper * positive_score. All rows are
    scored against all anchors; scores are exact (doubles where they suffice, else integers).

    Rows with a null label or vector or a null or non-finite component take no part. Rows without vec_id are never anchors unless
    the column says so; they come last among equal scores. Each repeated row counts as a row, an anchor's copy among its positives.
    Shorter vectors end in zeros, empty ones score 0. A score beyond the range of long is held to it. An empty table, or one
    without anchors, gives an empty result; extra columns are ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = scratch.write("vectors", whole_vectors(vectors, scale).select("*", F.monotonically_increasing_id().alias("rid"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")))
    peak = F.coalesce(F.greatest(F.max(F.array_max("q").cast("decimal(20,0)")), -F.min(F.array_min("q").cast("decimal(20,0)"))), F.lit(0))
    n, n_anchors, peak, width = rows.agg(F.count("*"), F.count_if("is_anchor"), peak, F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    most = int(peak) ** 2 * width
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    shares = max(-(-n // SHARE), min(partitions_for(spark), -(-n // BLOCK)), 1)
    groups = max(1, -(-n_anchors // GROUP))
    narrow = "smallint" if peak < 2**15 else "int" if peak < 2**31 else "bigint"
    rows = rows.withColumn("q", F.col("q").cast(f"array<{narrow}>"))
    share, group = F.pmod(F.xxhash64("rid"), F.lit(shares)).cast("int"), F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).cast("int")
    every_row = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * shares + share)).alias("cell"), F.lit(True).alias("is_row"), "rid", "vec_id", "label", "q", F.lit(None).cast("array<long>").alias("positives"))

    def met(anchors: DataFrame, make: Callable, schema: str) -> DataFrame:
        dealt = anchors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda s: group * shares + s)).alias("cell"), F.lit(False).alias("is_row"), "rid", "vec_id", "label", "q", "positives")
        cells = every_row.unionByName(dealt).repartitionById(groups * shares, F.col("cell")).sortWithinPartitions("cell", "is_row")
        return cells.mapInArrow(_per_cell(make), schema)

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    own = rows.where("is_anchor").withColumn("positives", F.lit(None).cast("array<long>"))
    chosen = first(met(own, lambda a: Positives(a, kind, positives), Positives.SCHEMA), ["rid"], positives)
    chosen = scratch.write("positives", chosen.select("rid", (F.col("rank") - 1).alias("n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    of_each = chosen.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    ready = own.drop("positives").join(of_each, "rid")
    found = first(met(ready, lambda a: Negatives(a, kind, negatives, lower, upper), Negatives.SCHEMA), ["rid", "n"], negatives)
    named = chosen.join(own.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return found.join(named, ["rid", "n"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), anchor=F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS a, b.rid AS b, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other) AS n FROM s WHERE same QUALIFY n <= 5),
r AS (
  SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.a = p.a
  WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""
