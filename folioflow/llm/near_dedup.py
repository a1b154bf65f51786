"""Operator 7: near duplicates by SetSketch registers in bands, a joint likelihood estimate, and exact verification.

Registers are truncated minima on an exponential scale: register i of a set is floor(c - log_B(min of h_i)) kept in
one byte. They are mergeable (maximum of two sketches is the sketch of the union) and equal with a probability that
is at least about the Jaccard similarity. ROWS registers make a band; sets that agree in a band are candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, as_rows, hashed_words, shingle_hashes, sliced, table, text_key

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 40, 5
BASE = 1.08
#: Moves the scale so that sets of one shingle aren't truncated; sets of up to ten million aren't either.
OFFSET = 40
#: Kinds of heads: the head of a bucket is the smallest by a hash that is the same for every HEADS-th band.
HEADS = 2
#: Sets of a bucket that meet in one piece of work, and comparisons of sketches from which buckets with one largest component stay apart.
BLOCK = 512
WORK = 1 << 26
#: Pairs whose estimated similarity is below this (over 6 standard deviations below the threshold) aren't verified.
LEAST = 0.55

_rng = np.random.default_rng(20_240_229)
_ODD = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_LOG = np.log(BASE)


def registers(shingles: np.ndarray) -> np.ndarray:
    """One byte for each of BANDS * ROWS registers of a set of 64-bit hashes (not empty)."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_ODD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        mixed = short[None, at : at + 1024] ^ _XOR[:, None]
        mixed *= _ODD[:, None]
        np.minimum(least, mixed.min(1), out=least)
    unit = (least.astype(np.float64) + 1) / 2.0**32
    rate = -np.log1p(-np.minimum(unit, 1 - 1e-12))
    return np.clip(np.floor(OFFSET - np.log(rate) / _LOG), 0, 255).astype(np.uint8)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, jointly from how many are less, equal and greater.

    With cardinalities in the ratio u : v and intersection j (of the union), a register of the first exceeds the
    other with probability p(u - v j), where p(x) = -log_B(1 - x (B - 1) / B), and so on; a fine grid over j
    is searched for the greatest likelihood."""
    greater, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - greater - less
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    j = np.linspace(0, 1, 101)[None, :]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG, 1e-9, 1)
    more, fewer = p(u - v * j), p(v - u * j)
    chance = greater * np.log(more) + less * np.log(fewer) + equal * np.log(np.clip(1 - more - fewer, 1e-9, 1))
    chance = np.where(j <= np.minimum(u / v, v / u) + 1e-9, chance, -np.inf)
    return j[0, chance.argmax(1)]


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_hashes(hashed_words(text), WIDTH)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the whole sets reach the threshold."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        out = []
        for text in b["text"].to_pylist():
            s = shingle_set(text)
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s) else (0, None, None))
        found = zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], *[pa.array(x, kind) for x, kind in found]], ["doc_id", "text_key", "n_shingles", "set_id", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (128-bit digest of the set, null when empty) and registers of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(_sketched, "doc_id long, text_key long, n_shingles long, set_id binary, regs binary")


def link_components(edges: DataFrame, scratch: Scratch, name: str = "comps", rounds: int = 40) -> DataFrame:
    """node, comp (its smallest reachable node) for the edges a - b, by alternating large and small stars.

    A star's centre is found by a map-side aggregate; each round is a table of its own, the one before is deleted. Rounds
    grow with the logarithm of the longest path."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = scratch.write(f"{name}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sign(now)
    for k in range(1, rounds + 1 if before[0] else 1):
        now = scratch.write(f"{name}-{k}", star(star(now, True), False))
        scratch.drop(f"{name}-{k - 1}")
        if (after := sign(now)) == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _with_heads(pairs: DataFrame, values: DataFrame, same: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], scratch: Scratch, name: str) -> DataFrame:
    """node, head: the pairs (node, head) of which `same` says yes, given the values (node, ...) of both.

    Nodes meet a head in groups of about BLOCK; so its values are sent once a group, not once a pair, and a head of any
    number of nodes is spread over tasks."""
    large = scratch.write(f"{name}-large", pairs.groupBy("head").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    groups = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    placed = pairs.join(large, "head", "left").select("node", "head", F.pmod(F.xxhash64("node"), groups).alias("block"))
    others = placed.join(values, "node").withColumn("leads", F.lit(False))
    heads = placed.select("head", "block").distinct().join(values.withColumnRenamed("node", "head"), "head").withColumn("node", F.col("head")).withColumn("leads", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            at = np.maximum.accumulate(np.where(x.leads, np.arange(len(x)), 0))
            own = np.flatnonzero(~x.leads.to_numpy(bool))
            yield x.iloc[own[same(x.iloc[own], x.iloc[at[own]])]][["node", "head"]]
            held = x.iloc[at[-1:]]

    met = heads.unionByName(others).repartition("head", "block").sortWithinPartitions("head", "block", F.desc("leads"))
    return scratch.write(name, met.mapInPandas(run, "node long, head long"))


def _likely(x: pd.DataFrame, heads: pd.DataFrame) -> np.ndarray:
    if not len(x):
        return np.zeros(0, bool)
    a, b = (np.frombuffer(b"".join(r), np.uint8).reshape(len(x), -1) for r in (x.regs, heads.regs))
    n, m = x.n.to_numpy(float), heads.n.to_numpy(float)
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT) & (likely_jaccard(a, b, n, m) >= LEAST)


def _alike_texts(x: pd.DataFrame, heads: pd.DataFrame) -> np.ndarray:
    held, own, out = None, None, []
    for head, text, other in zip(heads["head"], x.text, heads.text):
        if head != held:
            held, own = head, shingle_set(other)
        out.append(alike(shingle_set(text), own))
    return np.array(out, bool)


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes."""
    wanted = sets.join(nodes.distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"), "text")
    return own.join(wanted, ["_id", "_key"]).select("node", "text")


def linked_sets(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n_shingles, set_id), and set_id, first_id, first_key: the smallest (doc_id, text_key) of the component of each set.

    Rows with equal shingle sets are one node, so a group of copies of any size is one node. Nodes that agree in a band
    share a bucket. First each member of a bucket is verified against its head; then, in buckets that still hold several
    components, all pairs across components whose estimate is high enough. So a group of near copies is linked by few
    pairs, no bucket is capped or divided. A pair of similarity 0.75 agrees in no band with probability (1 - 0.75^5)^40 < 2e-5."""
    rows = scratch.write("rows", sketches(docs))
    named = rows.where("set_id is not null and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_key"))
    sets = named.groupBy("set_id").agg(least.alias("first"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    sets = scratch.write("sets", sets.select("set_id", F.monotonically_increasing_id().alias("node"), "first.*", "n", "regs"))  # numbers hold once written
    key = lambda i: F.xxhash64(F.lit(i), F.substring("regs", i * ROWS + 1, ROWS))
    spread = sets.select("node", F.xxhash64("set_id").alias("draw"), F.posexplode(F.array(*map(key, range(BANDS)))).alias("band", "key"))
    draw = F.xxhash64("draw", F.col("band") % HEADS)
    sizes = spread.groupBy("key").agg(F.count("*").alias("size"), F.min_by("node", draw).alias("head")).where("size > 1")
    buckets = scratch.write("buckets", spread.join(sizes, "key").select("node", "key", "band", "head"))
    star = scratch.write("star", buckets.where("node <> head").select("node", "head").distinct())
    hopeful = _with_heads(star, sets.select("node", "n", "regs"), _likely, scratch, "hopeful")
    scratch.drop("star", "hopeful-large")
    links = _with_heads(hopeful, _texts(docs, sets, hopeful.select("node").union(hopeful.select("head"))), _alike_texts, scratch, "links")
    scratch.drop("hopeful", "links-large")
    links = links.select(F.col("node").alias("a"), F.col("head").alias("b"))
    comps = link_components(links, scratch)
    more = _apart_in_buckets(docs, buckets.select("node", "key", "band"), comps, sets, scratch)
    scratch.drop("buckets")
    if not more.isEmpty():
        comps = link_components(links.unionByName(more), scratch, "again")
    of_set = sets.select("set_id", "node", F.struct("doc_id", "text_key").alias("own")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = of_set.groupBy("comp").agg(F.min("own").alias("first"))
    return rows.drop("regs"), of_set.join(firsts, "comp").select("set_id", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see linked_sets for how links are found.

    Rows without words (null or blank text) have n_shingles 0 and are their own component; rows without doc_id are linked
    with nothing, have a null component and are kept; where rows repeat a doc_id, each goes with its own text's links; an empty
    table gives an empty result; extra columns are ignored."""
    return _told(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but one of each group of near copies only: that of the smallest (doc_id, text hash).

    Rows that are equal in doc_id and text are copies too: one stays. Rows without words (such as texts that an earlier step
    has emptied) are copies where their texts are equal. Rows without doc_id are in no group and stay. Null texts, empty
    tables and extra columns of any name are allowed."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    told = _told(docs).where("doc_id is not null")
    blank = told.where("n_shingles = 0")
    least = blank.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    blank = blank.drop("first_id", "first_key").join(least, "text_key").withColumn("first_key", F.col("text_key"))
    told = told.where("n_shingles > 0").unionByName(blank)
    chosen = (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    counted = told.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.max(chosen).alias("chosen"), F.count("*").alias("n"))
    decided = scratch.write("decided", counted.where("not chosen or n > 1"))
    rows = as_rows(docs)
    kept = rows.join(decided, ["i", "k"], "left_anti")
    if not (repeated := decided.where("chosen")).isEmpty():
        kept = kept.unionByName(rows.join(repeated, ["i", "k"], "left_semi").dropDuplicates(["i", "k"]))
    return kept.select("row.*")


def _told(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows, of_set = linked_sets(docs, scratch)
    with_set = rows.where("set_id is not null").join(of_set, "set_id", "left").drop("set_id")
    none = F.lit(None).cast("long")
    whole = with_set.unionByName(rows.where("set_id is null").drop("set_id").withColumns({"first_id": none, "first_key": none}))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id"))
    told = scratch.write("told", whole.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), "first_id", "first_key"))
    scratch.drop("rows", "sets", "links", "more", *[f"{n}-{k}" for n in ("comps", "again") for k in range(41)])
    return told
def _mixed(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of the buckets of over two nodes that hold several components: with comp, size, major (the bucket's largest
    component) and minor (how many nodes are in others)."""
    tagged = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = tagged.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.sum("n").alias("size"), F.max_by("comp", "n").alias("major"), (F.sum("n") - F.max("n")).alias("minor")).where("minor > 0 and size > 2")
    return tagged.join(mixed, "key")


def _apart_in_buckets(docs: DataFrame, buckets: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b (a > b): the links between a bucket's nodes that are in different components.

    Nodes outside a bucket's largest component are compared with all its nodes that agree in a band, in blocks of both: by sketch,
    then, where the estimate lets them through, by their whole sets. Buckets with the same largest component meet as
    one, so a node goes there once, not once a band; where that would take more than WORK comparisons, they stay apart, and a pair is
    verified in the first band it agrees in only. No bucket is divided: the block pairs of a large one are spread over tasks."""
    rows = scratch.write("mixed", _mixed(buckets.withColumn("first", F.col("band")), comps))
    met = scratch.write("met", rows.select("major", "node", "comp").distinct())
    sums = scratch.write("sums", met.groupBy("major").agg(F.count("*").alias("size"), F.sum((F.col("comp") != F.col("major")).cast("long")).alias("minor")))
    dealt = _blocks(met.join(sums.where(F.col("minor") * F.col("size") <= WORK), "major").withColumn("key", F.col("major")).withColumn("first", F.lit(-1)))
    rows = rows.join(sums.where(F.col("minor") * F.col("size") > WORK).select("major"), "major", "left_semi")
    dealt = dealt.unionByName(_blocks(rows))
    texts = scratch.write("texts", sets.select("node", "n", "regs").join(_texts(docs, sets, met.select("node")), "node"))
    full = dealt.join(texts, "node")

    def pairs(group: list[tuple]) -> pd.DataFrame:
        node, comp, asks, first, n = (np.array([g[k] for g in group]) for k in range(5))
        regs = np.stack([np.frombuffer(g[5], np.uint8) for g in group])
        bands = regs.reshape(len(group), BANDS, ROWS)
        known: dict[int, np.ndarray] = {}

        def own_set(k: int) -> np.ndarray:
            if k not in known:
                known[k] = shingle_set(group[k][6])
            return known[k]

        found = []
        for q in np.flatnonzero(asks):
            near = np.flatnonzero(~asks & (comp != comp[q]) & (np.minimum(n, n[q]) * 100 >= np.maximum(n, n[q]) * PERCENT))
            agree = (bands[near] == bands[q]).all(2)
            near = near[np.where(first[near] < 0, agree.any(1), agree.argmax(1) == first[near])]
            if len(near):
                like = likely_jaccard(np.broadcast_to(regs[q], (len(near), regs.shape[1])), regs[near], np.full(len(near), float(n[q])), n[near].astype(float))
                found += [(max(node[q], node[x]), min(node[q], node[x])) for x in near[like >= LEAST] if alike(own_set(q), own_set(x))]
        return pd.DataFrame(found, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group = None, []
        for x in batches:
            for key, i, j, *rest in zip(x.key, x.i, x.j, x.node, x.comp, x.asks, x["first"], x.n, x.regs, x.text):
                if (key, i, j) != held:
                    if len(group) > 1:
                        yield pairs(group)
                    held, group = (key, i, j), []
                group.append(rest)
        if len(group) > 1:
            yield pairs(group)

    found = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long").distinct()
    more = scratch.write("more", found)
    scratch.drop("mixed", "met", "sums", "texts")
    return more


def _blocks(rows: DataFrame) -> DataFrame:
    """key, i, j, node, comp, asks, first (the band in which a pair counts, -1: any): nodes outside the largest component ask in block i, all nodes answer in block j."""
    asking, all_ = F.ceil(F.col("minor") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    ask = rows.where("comp <> major").select("key", place(asking).alias("i"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("j"), "node", "comp", F.lit(True).alias("asks"), "first")
    answer = rows.select("key", F.explode(F.sequence(F.lit(0), asking - 1)).alias("i"), place(all_).alias("j"), "node", "comp", F.lit(False).alias("asks"), "first")
    return ask.unionByName(answer)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
