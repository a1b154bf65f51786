"""Range, validity and order operators over time: each is one sort or one equi join on a key, never a cross join."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def with_ends(items: DataFrame, key: str, start: str, last_end: Column, then: Sequence[str] = ()) -> DataFrame:
    """[WN11] end: the next item's start; the last one's is last_end, never before its own start. `then` orders equal starts."""
    order = Window.partitionBy(key).orderBy(start, *then)
    return items.withColumn("end", F.coalesce(F.lead(start).over(order), F.greatest(last_end, F.col(start))))


def latest_range(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, id_: str) -> DataFrame:
    """[JN5, CX2] points with the id of the half-open range that holds them; of several the one that starts last, then the
    smallest id. Points and range starts are sorted together in each key: as many rows as both tables have, where a theta
    join would make one for each pair. Only points at which the range that started last has ended, but an earlier one hasn't
    (nested ranges), are swept in order of time with the ranges that are open then. Equal points each give a row; without a key there's no range."""
    row_type = points.select(F.struct(*points.columns).alias("_row")).schema["_row"].dataType
    tagged = points.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_p"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("struct<start:bigint,end:bigint,id:bigint>").alias("_r"))
    opened = F.struct(F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(id_).cast("long").alias("id"))
    usable = ranges.where((F.col(end) > F.col(start)) & F.col(key).isNotNull())
    starts = usable.select(F.col(key).alias("_k"), F.col(start).alias("_t"), F.lit(0).alias("_p"), F.lit(None).cast(row_type).alias("_row"), opened.alias("_r"))
    order = Window.partitionBy("_k").orderBy("_t", "_p", F.desc("_r.id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = tagged.unionByName(starts).withColumns({"_last": F.last("_r", ignorenulls=True).over(order), "_until": F.max("_r.end").over(order)}).where("_p = 1")
    sure = (F.col("_t") < F.col("_last.end")) | F.coalesce(F.col("_t") >= F.col("_until"), F.lit(True))
    flat = seen.select("_k", "_t", "_p", "_row", "_r", F.when(F.col("_t") < F.col("_last.end"), F.col("_last.id")).alias("range_id"), F.coalesce(sure, F.lit(True)).alias("_sure"))
    nested = flat.where("not _sure").drop("range_id", "_sure")
    both = nested.unionByName(starts.join(nested.select("_k").distinct(), "_k", "left_semi"))
    # dealt by a hash of its own: a union of tables that lie by the key already counts as lying by it, though its tasks hold parts only
    swept = both.repartition(F.xxhash64("_k")).sortWithinPartitions("_k", "_t", "_p").mapInArrow(_sweep, StructType([StructField("_row", row_type), StructField("range_id", LongType())]))
    return flat.where("_sure").select("_row.*", "range_id").unionByName(swept.select("_row.*", "range_id"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each point, in order of key and time, the open range that started last. Holds the ranges that are open, and at most as many that have
    ended beneath them, whatever a key has of rows."""
    key, by_start, ends = None, [], []
    for batch in batches:
        at, ids = [], []
        for i, (k, t, is_point, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_k", "_t", "_p", "_r")))):
            if k != key:
                key, by_start, ends = k, [], []
            while ends and ends[0] <= t:
                heapq.heappop(ends)
            if is_point:
                while by_start and by_start[0][2] <= t:
                    heapq.heappop(by_start)
                at.append(i)
                ids.append(by_start[0][1] if by_start else None)
            else:
                heapq.heappush(by_start, (-r["start"], r["id"], r["end"]))
                heapq.heappush(ends, r["end"])
            if len(by_start) > 2 * len(ends) + 64:
                by_start = [x for x in by_start if x[2] > t]
                heapq.heapify(by_start)
        yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(at, pa.int64())), pa.array(ids, pa.int64())], ["_row", "range_id"])


def held_on(seats: DataFrame, on: Column) -> Column:
    """[JN7] Open bounds count as always."""
    return F.coalesce(F.col("start_date") <= on, F.lit(True)) & F.coalesce(F.col("end_date") >= on, F.lit(True))


def sole_holders(seats: DataFrame, on: Column) -> DataFrame:
    """[JN8] title, person_id of the titles that one person only holds on the day."""
    held = seats.where(held_on(seats, on))
    return held.groupBy("title").agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").select("title", "person_id")


def runs(lines: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """[WN5] run: how many rows up to this one open a run."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("run", F.sum(opens.cast("long")).over(w))


def last_in_order(candidates: DataFrame) -> DataFrame:
    """[SL6] The longest chain of (item, time) with items rising and times not falling, a group: group, item, time.

    Among chains of one length the one with the smaller sum of times, then the first found. A group becomes one sorted row
    (a meeting's agenda, bounded by its items), and each batch of rows is one function call."""
    listed = candidates.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("item", "time"))).alias("rows"))
    kinds = dict(candidates.dtypes)
    schema = f"group {kinds['group']}, chain array<struct<item:{kinds['item']},time:{kinds['time']}>>"

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"group": b["group"], "chain": [_chain(list(rows)) for rows in b["rows"]]})

    return listed.mapInPandas(chains, schema).select("group", F.inline("chain"))


def _chain(rows: list[dict]) -> list[dict]:
    """By a tree of prefix maxima over the ranks of times, item by item: n log n steps."""
    rank = {t: k + 1 for k, t in enumerate(sorted({x["time"] for x in rows}))}
    tree: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(rank) + 1)  # length, minus the sum, minus the row's number
    best: list[tuple[int, int, int]] = []  # length, minus the sum, the row before
    for _, group in itertools.groupby(range(len(rows)), key=lambda i: rows[i]["item"]):
        own = list(group)
        for i in own:
            k, top = rank[rows[i]["time"]], (0, 0, 0)
            while k:
                top, k = max(top, tree[k]), k & (k - 1)
            best.append((top[0] + 1, top[1] - rows[i]["time"], -top[2] if top[0] else -1))
        for i in own:
            k, mark = rank[rows[i]["time"]], (best[i][0], best[i][1], -i)
            while k < len(tree):
                tree[k], k = max(tree[k], mark), k + (k & -k)
    at = max(range(len(best)), key=lambda i: best[i][:2], default=-1)
    kept = []
    while at >= 0:
        kept.append(rows[at])
        at = best[at][2]
    return kept[::-1]


def agreed_offset(values: DataFrame, key: str, value: str, tolerance: float, least: int) -> DataFrame:
    """[AG11] key, offset, support: the half-even rounded median of the values within `tolerance` of the best centre.

    The best centre has the most values near it, then is the smallest; fewer than `least` give no offset. A running count over
    the sorted values takes the place of a self join; only the values near the winner are looked at again."""
    reach = round(tolerance * 1000)  # frames need whole numbers: thousandths
    at = F.round(F.col(value) * 1000).cast("long")
    near = Window.partitionBy(key).orderBy("_at").rangeBetween(-reach, reach)
    placed = values.select(key, F.col(value).cast("double").alias("_v"), at.alias("_at"))
    counted = placed.withColumn("_n", F.count("*").over(near))
    best = counted.groupBy(key).agg(F.max_by("_at", F.struct("_n", -F.col("_at"))).alias("_centre"), F.max("_n").alias("support"))
    close = placed.join(best, key).where(F.abs(F.col("_at") - F.col("_centre")) <= reach)
    middle = close.groupBy(key, "support").agg(F.percentile("_v", 0.5).alias("_m"))
    return middle.select(key, F.when(F.col("support") >= least, F.bround("_m", 0).cast("long")).alias("offset"), "support")
