"""[FT1, FT7] A full-text index that is built once and kept as tables; a search reads postings, never texts.

rows      did (number of the row), the key, other kept columns, n (tokens)
terms     bucket, term, df (rows that hold it)
postings  bucket, blk, term, first, last, n, best, and packed: dids, counts, sizes, places

A block holds up to BLOCK postings of one term in the order of did, none of two shards (did >> SHARD). Numbers are packed as the
differences from those before them, in bytes of seven bits. `best` is the most that a posting of the block can add to a BM25
score but for the term's weight: a search for the best k takes blocks by that bound and stops where no other can reach the k-th score.
Files are sorted by term and blk in folders of buckets, so the filters of a search reach the scan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import search_terms
from folioflow.operators.search import B, K1, LEAST_IDF, OVER_FETCH, one_hit_per_mention, query_terms, windows
from folioflow.sources.cuts import remove

BLOCK, SHARD, BUCKETS = 128, 16, 64
#: Tokens whose postings are told apart at once in a task.
HELD_TOKENS = 1 << 20
#: Cells (a block of the rarest term and the blocks of the others beside it) that a search reads first; each further round reads four times as many, up to MOST_CELLS at once.
FIRST_CELLS, MOST_CELLS = 16, 256
#: Scores are rounded to six decimals, so a bound that falls short by less isn't told from one that reaches.
SLACK = 1e-6


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits, the last of each below 128; and where each one starts, with the end."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(7, 64, 7):
        width += values >= np.uint64(1 << k)
    starts = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        more = (width[has] > k + 1).astype(np.uint8) << 7
        out[starts[:-1][has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, starts


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & np.uint8(127)).astype(np.int64) << (7 * place), starts)


#: What a task packs; and the tables, which are kept in folders of buckets.
POSTINGS = "bucket int, term string, first long, last long, n int, best double, dids binary, counts binary, sizes binary, places binary"
TABLES = {"postings": POSTINGS.removeprefix("bucket int, ") + ", blk long, bucket int", "terms": "term string, df long, bucket int"}


def _most(counts: np.ndarray, sizes: np.ndarray, mean: float) -> np.ndarray:
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes / mean))


def _pack(mean: float):
    """Cuts sorted postings (bucket, term, did, size, places) into blocks. Only the last, unfinished block is held between batches."""

    def starts_of(t: pa.Table) -> np.ndarray:
        term, did = t.column("term"), t.column("did").to_numpy()
        other = np.ones(len(did), bool)
        other[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy() | (np.diff(did >> SHARD) != 0)
        at = np.arange(len(did))
        opened = np.maximum.accumulate(np.where(other, at, 0))
        return np.flatnonzero((at - opened) % BLOCK == 0)

    def blocks(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        did, sizes = t.column("did").to_numpy(), t.column("size").to_numpy()
        places = t.column("places").combine_chunks()
        counts = places.value_lengths().to_numpy().astype(np.int64)
        heads = np.concatenate([[0], np.cumsum(counts)])
        at, steps = places.flatten().to_numpy().astype(np.int64), np.diff(did, prepend=did[:1])
        steps[starts] = 0
        hops = np.diff(at, prepend=at[:1])
        hops[heads[:-1]] = at[heads[:-1]]

        def column(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
            data, ends = packed(values)
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends[cuts].astype(np.int32)), pa.py_buffer(data)])

        ends = np.append(starts[1:], len(did))
        cuts = np.append(starts, len(did))
        own = t.select(["bucket", "term"]).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns),
                *map(pa.array, (did[starts], did[ends - 1], (ends - starts).astype(np.int32), np.maximum.reduceat(_most(counts, sizes, mean), starts))),
                column(steps, cuts), column(counts, cuts), column(sizes, cuts), column(hops, heads[cuts]),
            ],
            POSTINGS.replace(",", "").split()[::2],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            starts = starts_of(t)
            if len(starts) > 1:
                yield blocks(t.slice(0, starts[-1]).combine_chunks(), starts[:-1])
            held = t.slice(starts[-1])
        if held is not None:
            yield blocks(held.combine_chunks(), np.array([0]))

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their tokens (did, tokens) as rows of did, size, term, places: a row's tokens are sorted where they are, in slices of bounded length."""
    for b in batches:
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        low = 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + HELD_TOKENS, side="right")) - 1)
            part, sizes = b.slice(low, high - low), np.diff(ends[low : high + 1])
            low = high
            if not sizes.sum():
                continue
            words = part.column("tokens").flatten().dictionary_encode()
            code = words.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(row * len(words.dictionary) + code, kind="stable")  # places stay ascending
            row, code = row[order], code[order]
            starts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(code) != 0)))
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            own = row[starts]
            yield pa.RecordBatch.from_arrays([part.column("did").take(pa.array(own)), pa.array(sizes[own].astype(np.int32)), words.dictionary.take(pa.array(code[starts])), places], ["did", "size", "term", "places"])


def _unpack(with_places: bool):
    """Blocks as postings again: term, did, count, size, and places where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            whole = lambda c: unpacked(b"".join(b.column(c).to_pylist()))  # noqa: E731, B023
            n = b.column("n").to_numpy()
            heads = np.concatenate([[0], np.cumsum(n)])[:-1]
            total = np.cumsum(whole("dids"))
            did = np.repeat(b.column("first").to_numpy() - total[heads], n) + total
            counts = whole("counts")
            columns = [b.column("term").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(did), pa.array(counts), pa.array(whole("sizes"))]
            if with_places:
                hops, ends = whole("places"), np.concatenate([[0], np.cumsum(counts)])
                total = np.cumsum(hops)
                at = total - np.repeat(total[ends[:-1]] - hops[ends[:-1]], counts)
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at)))
            yield pa.RecordBatch.from_arrays(columns, ["term", "did", "count", "size", "places"][: len(columns)])

    return run


def build(docs: DataFrame, key: list[str], path: str, keep: list[str] = (), partitions: int | None = None) -> TextIndex:
    """Builds the index of docs (key, text and the columns to keep) at path. Each text is tokenised once.

    A null text has no tokens and is a row of the corpus all the same. A text's own postings are told apart where it is read; they are shuffled once, dealt by ranges of (bucket, term, did), so the
    postings of a common word lie in many tasks."""
    spark = docs.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged, own = f"{path}/staged", [*key, *keep]
    docs.select(F.monotonically_increasing_id().alias("did"), *own, search_terms(F.col("text")).alias("tokens")).write.mode("overwrite").parquet(staged)
    tokens = spark.read.parquet(staged)
    tokens.select("did", *own, F.size("tokens").alias("n")).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").first()["mean"] or 1.0
    held = tokens.select("did", "tokens").mapInArrow(_held, "did long, size int, term string, places array<int>")
    per = held.withColumn("bucket", _bucket(F.col("term")))
    order = ["bucket", "term", "did"]
    blocks = per.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("bucket", "term", "did", "size", "places").mapInArrow(_pack(mean), POSTINGS)
    kept = blocks.withColumn("blk", F.monotonically_increasing_id()).sortWithinPartitions("bucket", "blk")
    small = {"parquet.page.size": 1 << 16, "parquet.page.row.count.limit": 512}  # pages whose range of blk isn't asked for aren't read
    kept.write.mode("overwrite").options(**small).partitionBy("bucket").parquet(f"{path}/postings")
    terms = spark.read.schema(TABLES["postings"]).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    terms.repartition(min(parts, BUCKETS), "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    remove(spark, staged)
    return TextIndex(spark, path, key)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index that build() left at path. blocks_read: how many blocks of postings the last top() unpacked."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.key, self.blocks_read = spark, key, 0
        self.rows = spark.read.parquet(f"{path}/rows")
        self._terms, self._postings = (spark.read.schema(TABLES[t]).parquet(f"{path}/{t}") for t in ("terms", "postings"))
        self.docs, self.mean = spark.read.parquet(f"{path}/stats").first()

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms; both filters reach the scan, that on buckets the choice of folders."""
        return table.where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in terms]) & F.col("term").isin(*terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        return {r["term"]: r["df"] for r in self._of(self._terms, terms).select("term", "df").collect()} if terms else {}

    def postings(self, terms: list[str], places: bool = False, only: Column | None = None) -> DataFrame:
        """term, did, count, size (and places) of all postings of some terms, or of those in the blocks that `only` chooses."""
        blocks = self._of(self._postings, terms)
        blocks = (blocks.where(only) if only is not None else blocks).select("term", "first", "n", "dids", "counts", "sizes", *["places"] * places)
        return blocks.mapInArrow(_unpack(places), "term string, did long, count long, size long" + ", places array<long>" * places)

    def _none(self) -> DataFrame:
        return self.rows.where("false").drop("did", "n")

    def matching(self, terms: list[str]) -> DataFrame:
        """[FT5] The rows (key and kept columns) that hold every term. No terms match nothing."""
        several = list(dict.fromkeys(terms))
        if not several:
            return self._none()
        hits = self.postings(several).groupBy("did").agg(F.count("*").alias("held")).where(F.col("held") == len(several)).select("did")
        return self.rows.join(hits, "did", "left_semi").drop("did", "n")

    def phrase(self, terms: list[str], of: DataFrame | None = None) -> DataFrame:
        """[FT6] The rows that hold the terms side by side in their order; of: only rows with these keys are asked."""
        if not terms:
            return self._none()
        found = self.postings(list(dict.fromkeys(terms)), places=True)
        asked = self.rows if of is None else self.rows.join(of.select(*self.key), self.key, "left_semi")
        found = found if of is None else found.join(F.broadcast(asked.select("did")), "did", "left_semi")
        per = found.groupBy("did").agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(terms)])
        back = lambda i: F.transform(f"p{i}", lambda p: p - i)  # noqa: E731  where the phrase would begin
        starts = reduce(F.array_intersect, map(back, range(len(terms))))
        return asked.join(per.where(F.size(starts) > 0).select("did"), "did", "left_semi").drop("did", "n")

    def _weights(self, terms: list[str], df: dict[str, int]) -> dict[str, float]:
        """How much a term's part of a score counts, times how often it is asked for."""
        idf = {t: max(LEAST_IDF, float(np.log((self.docs - df[t] + 0.5) / (df[t] + 0.5)))) for t in df}
        return {t: idf[t] * terms.count(t) for t in df}

    def _cells(self, several: list[str], weights: dict[str, float]) -> DataFrame:
        """blks, bound: each block of the first term with the blocks of the others that reach into its range of rows, and the best score (as
        a positive number) that a row in all of them may have. Reads only the blocks' heads."""
        heads = self._of(self._postings, several).select("term", "blk", F.shiftright("first", SHARD).alias("shard"), "first", "last", "best")
        lead = heads.where(F.col("term") == several[0])
        if len(several) == 1:
            return lead.select(F.array("blk").alias("blks"), (F.col("best") * weights[several[0]]).alias("bound"))
        other = heads.where(F.col("term") != several[0]).toDF("term", "o_blk", "shard", "o_first", "o_last", "o_best")
        beside = lead.drop("term").join(other, "shard").where("o_first <= last and o_last >= first")
        part = lambda t: F.max(F.when(F.col("term") == t, F.col("o_best") * weights[t]))
        per = beside.groupBy("blk", "best").agg(F.collect_list("o_blk").alias("others"), *[part(t).alias(f"b{i}") for i, t in enumerate(several[1:])])
        bound = reduce(lambda a, b: a + b, [F.col(f"b{i}") for i in range(len(several) - 1)], F.col("best") * weights[several[0]])
        return per.select(F.array_append("others", F.col("blk")).alias("blks"), bound.alias("bound")).where("bound is not null")  # null: a term has no block there

    def _scores(self, terms: list[str], several: list[str], df: dict[str, int], only: Column) -> DataFrame:
        """did, score of the rows that hold every term in the chosen blocks."""
        per = self.postings(several, only=only).groupBy("did", "size").agg(*[F.max(F.when(F.col("term") == t, F.col("count"))).alias(f"c{i}") for i, t in enumerate(several)])
        hit = per.where(" and ".join(f"c{i} is not null" for i in range(len(several))))
        score, n_docs, mean = F.lit(0.0), F.lit(self.docs), F.lit(self.mean)
        for t in dict.fromkeys(terms):
            c = F.col(f"c{several.index(t)}")
            idf = F.greatest(F.lit(LEAST_IDF), F.log((n_docs - F.lit(df[t]) + 0.5) / (F.lit(df[t]) + 0.5)))
            score = score - idf * (c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("size") / mean))) * terms.count(t)
        return hit.select("did", F.round(score, 6).alias("score"))

    def top(self, terms: list[str], k: int, where: DataFrame | None = None) -> DataFrame:
        """[FT7, SL1] The k best rows that hold every term: key, kept columns, score (lower is better), by (score, key).

        where: keys of the rows that count; others are left out before the cut, while the corpus that scores are made of stays whole.
        Cells are read by their bounds, best first, in rounds; after each the driver holds the k best rows so far. No cell is
        passed over that could hold one of them."""
        self.blocks_read = 0
        several = list(dict.fromkeys(terms))
        df = self.frequencies(several)
        own = self.rows.drop("did", "n").schema.add("score", "double")
        if k <= 0 or not several or len(df) < len(several):
            return self.spark.createDataFrame([], own)
        several.sort(key=lambda t: (df[t], t))
        cells = self._cells(several, self._weights(terms, df)).select(F.array_sort("blks").alias("blks"), "bound").orderBy(F.desc("bound"), "blks")
        best, read, seen = [], 0, set()
        while True:
            step = min(MOST_CELLS, max(FIRST_CELLS, 3 * read))
            taken = cells.offset(read).limit(step).collect()  # a bounded number of heads
            if not taken or (len(best) == k and taken[0]["bound"] < -best[-1]["score"] - SLACK):
                break
            if len(best) == k:
                taken = [c for c in taken if c["bound"] >= -best[-1]["score"] - SLACK]
            read += len(taken)
            # two cells may share a block of another term, but no row is in two blocks of the first one, so no row comes twice
            blks = sorted({b for c in taken for b in c["blks"]})
            self.blocks_read += len(set(blks) - seen)
            seen |= set(blks)
            leads = self._scores(terms, several, df, _one_of(blks))
            hits = self.rows.join(F.broadcast(leads), "did").drop("did", "n")  # at most BLOCK rows a block
            hits = hits if where is None else hits.join(where.select(*self.key), self.key, "left_semi")
            new = hits.orderBy("score", *self.key).limit(k).collect()
            order = lambda r: (r["score"], *[(r[c] is not None, r[c]) for c in self.key])
            best = sorted({tuple(r[c] for c in (*self.key, "score")): r for r in [*best, *new]}.values(), key=order)[:k]
            if len(taken) < step:
                break
        return self.spark.createDataFrame([tuple(r[c] for c in own.names) for r in best], own)


def _one_of(blks: list[int]) -> Column:
    """blk is one of these: a balanced choice of ranges, which the scan can test against the ranges of its pages."""
    runs: list[list[int]] = []
    for b in blks:
        if runs and b == runs[-1][1] + 1:
            runs[-1][1] = b
        else:
            runs.append([b, b])
    tests = [F.col("blk") == a if a == b else F.col("blk").between(a, b) for a, b in runs]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) - len(tests) % 2 :]
    return tests[0]


def index_lines(lines: DataFrame, path: str) -> TextIndex:
    """[FT2, FT3] The index of the windows of transcript lines (transcript_id, id, start_ms, text): one to three lines, one corpus."""
    return build(windows(lines), ["transcript_id", "last_id", "span"], path, ["first_pos", "last_pos"])


def search_lines(index: TextIndex, q: str, limit: int, transcripts: DataFrame | None = None) -> DataFrame:
    """[FT10] As search.search_lines, by an index of windows: transcript_id, last_id, span, first_pos, last_pos, phrase, score.

    transcripts: only these transcript_ids count; they are chosen before the cut."""
    terms = query_terms(q)
    where = None if transcripts is None else index.rows.join(transcripts.select("transcript_id").distinct(), "transcript_id", "left_semi").select(*index.key)
    ranked = index.top(terms, OVER_FETCH * max(0, limit), where)
    spoken = index.phrase(terms, ranked).select(*index.key, F.lit(True).alias("phrase"))
    hits = ranked.join(F.broadcast(spoken), index.key, "left").select(*index.key, "first_pos", "last_pos", F.coalesce("phrase", F.lit(False)).alias("phrase"), "score")  # at most the ranked rows
    return one_hit_per_mention(hits).orderBy(F.desc("phrase"), "span", "score", "transcript_id", "first_pos").limit(max(0, limit))
