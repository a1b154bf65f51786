"""Operator 12: a Merkle manifest of a dataset, built by a postorder traversal of aligned blocks.

A tree's leaves, in order, are cut into blocks of RUN ** HEIGHT. A task walks one block in postorder: each subtree returns its
digest and, while unwinding, appends siblings to the leaves it contains. The blocks' roots are the leaves of another
distributed traversal, and so on; what that finds for a block is appended to all its leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioflow.llm.common import Scratch, partitions_for, table

#: Nodes that become one, and levels of a block.
RUN, HEIGHT = 8, 4
#: A table of the ranges' offsets with more rows is joined by merging.
BROADCAST = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _node(digests: list[bytes]) -> bytes:
    """The digest over the hexadecimal texts of others."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def traverse(leaves: list[bytes], height: int, run: int = RUN) -> tuple[bytes, list[list[bytes]], list[bytearray]]:
    """The root of the leaves, `height` levels up; for each leaf its siblings by level (joined), and its places.

    A place is one byte a level: where the node stands in its run, times run, and how many siblings it has."""
    siblings, places = [[] for _ in leaves], [bytearray() for _ in leaves]

    def walk(start: int, level: int) -> bytes:
        if level == 0:
            return leaves[start]
        step = run ** (level - 1)
        starts = range(start, min(start + step * run, len(leaves)), step)
        children = [walk(s, level - 1) for s in starts]
        for at, s in enumerate(starts):
            others, place = b"".join(children[:at] + children[at + 1 :]), at * run + len(children) - 1
            for leaf in range(s, min(s + step, len(leaves))):
                siblings[leaf].append(others)
                places[leaf].append(place)
        return _node(children)

    return walk(0, height), siblings, places


def height_of(n: int, run: int = RUN) -> int:
    """Levels above n nodes of one block."""
    up = 0
    while run**up < n:
        up += 1
    return up


@F.pandas_udf(BinaryType())
def climbed(leaf: pd.Series, siblings: pd.Series, places: pd.Series) -> pd.Series:
    """The root that follows from a leaf's digest, its siblings and its places."""

    def root(node: bytes, others: bytes, levels: bytes) -> bytes:
        told, at = others.hex(), 0
        for level in levels:
            place, n = divmod(level, RUN)
            run = told[at : at + 64 * n]
            node = hashlib.sha256(f"{run[: 64 * place]}{node.hex()}{run[64 * place :]}".encode()).digest()
            at += 64 * n
        return node

    return pd.Series([root(*x) for x in zip(leaf, siblings, places)], dtype=object)


def leaf_of(text: Column | None = None) -> Column:
    """A row's digest: each of FIELDS as its length in bytes, a colon and its value, or a hyphen for null."""

    def part(c: str) -> Column:
        value = (text if text is not None and c == "text" else F.col(c)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in FIELDS]).cast("binary"), 256))


def _ranked(nodes: DataFrame, keys: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Adds pos (0, 1, ... in each g, by keys) and n (rows of g). Rows are dealt by ranges, which no group makes larger."""
    spread = nodes.repartitionByRange(partitions_for(nodes.sparkSession), "g", *keys).sortWithinPartitions("g", *keys)
    placed = scratch.write(f"{name}-sorted", spread.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    ranges = placed.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    totals = ranges.groupBy("g").agg(F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("part", "rows", "first"))).alias("parts"))
    # parts has one entry a range that holds the group, at most as many as there are partitions
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, p: s + p["rows"])
    told = totals.select("g", "n", "parts", F.posexplode("parts").alias("i", "p")).select("g", "n", "p.part", (before - F.col("p.first")).alias("shift"))
    told = scratch.write(f"{name}-ranges", told)
    told = F.broadcast(told) if told.count() <= BROADCAST else told.hint("merge")
    return placed.join(told, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


Above = Callable[[DataFrame], DataFrame]
_PATH = ["siblings", "places", "subroot", "root"]


def _proved(nodes: DataFrame, above: Above, scratch: Scratch, name: str) -> DataFrame:
    """Adds siblings, places (both up to the root), subroot and root to nodes (g, pos, n, node and others).

    above: what stands over the last node of each g, from (g, block, node) to (g, block, siblings, places, subroot, root)."""
    size = RUN**HEIGHT
    cells = nodes.withColumn("block", F.floor(F.col("pos") / size))
    rises = lambda n: HEIGHT if n > size else height_of(n)

    def own_root(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t.column("n")[0].as_py()
        root, _, _ = traverse(t.column("node").to_pylist(), rises(n))
        return pa.table({"g": t.column("g")[:1], "block": t.column("block")[:1], "n": [-(-n // size)], "node": [root]})

    roots = cells.select("g", "block", "pos", "n", "node").groupBy("g", "block").applyInArrow(own_root, "g string, block long, n long, node binary")
    roots = scratch.write(f"{name}-roots", roots)
    if roots.where("n > 1").isEmpty():
        over = above(roots.select("g", "block", "node"))
    else:
        over = _proved(roots.withColumnRenamed("block", "pos"), above, scratch, f"{name}-up").select("g", F.col("pos").alias("block"), *_PATH)

    def with_paths(own: pa.Table, over: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        _, siblings, places = traverse(own.column("node").to_pylist(), rises(own.column("n")[0].as_py()))
        up_siblings, up_places, subroot, root = (over.column(c)[0].as_py() for c in _PATH)
        found = [[b"".join(s) + up_siblings for s in siblings], [bytes(p) + up_places for p in places], [subroot] * len(own), [root] * len(own)]
        for c, values in zip(_PATH, found):
            own = own.append_column(c, pa.array(values, pa.binary()))
        return own.drop_columns(["block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + "".join(f", {c} binary" for c in _PATH)
    return cells.groupBy("g", "block").cogroup(over.groupBy("g", "block")).applyInArrow(with_paths, schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, more, siblings, places, subroot, root for every row of leaves (doc_id, lang, leaf binary, more binary).

    The leaves of a language, by doc_id, are a tree: while several nodes remain, each RUN in turn become one, whose digest is that
    of their hexadecimal digests. What remains is the language's subroot; subroots by language, null first, then by bytes, make
    one tree more, whose top is the root. siblings: the 32-byte digests that lead from the leaf to the root, by level, left to
    right; places: one byte a level (see traverse). more is handed on.

    Rows without doc_id come first in their language; equal doc_ids stand by their digests, and repeated rows are leaves of their own.
    An empty table gives an empty result."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    g = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    rows = leaves.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("node"), "more", F.monotonically_increasing_id().alias("tie"))
    rows = scratch.write("leaves", rows)
    none = F.lit(b"")

    def alone(roots: DataFrame) -> DataFrame:
        return roots.select("g", "block", none.alias("siblings"), none.alias("places"), F.col("node").alias("subroot"), F.col("node").alias("root"))

    def through_languages(roots: DataFrame) -> DataFrame:
        tops = roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "node")  # one a language, in its block 0
        tree = _proved(_ranked(tops, [F.col("of")], scratch, "languages"), alone, scratch, "languages")
        return tree.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("block"), "siblings", "places", F.col("node").alias("subroot"), "root")

    # ties of doc_id and digest are told apart by a number of no meaning, so that equal rows can be dealt out too
    ranked = _ranked(rows, [F.col("doc_id"), F.col("node"), F.col("tie")], scratch, "rows").drop("tie")
    return _proved(ranked, through_languages, scratch, "rows").select("doc_id", F.col("node").alias("leaf"), "more", *_PATH)


def _told(c: str) -> Column:
    return F.lower(F.hex(c))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, leaf_of(F.translate("text", UPPER, LOWER)))
    found = manifest(docs.select("doc_id", "lang", leaf_of().alias("leaf"), changed.alias("more")))
    out = found.withColumn("folded", climbed(F.coalesce("more", "leaf"), "siblings", "places"))
    proof = F.sha2(_told("siblings").cast("binary"), 256)
    return out.select("doc_id", _told("leaf").alias("leaf"), _told("subroot").alias("subroot"), _told("root").alias("root"), proof.alias("proof_sha256"), _told("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


_STEP = "xor(r >> 1, 3988292384 * (r & 1))"
_FIELD = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR END"
_LEAF = lambda text: f"sha256({' || '.join(_FIELD(text if c == 'text' else c) for c in FIELDS)})"
OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER () AS rid, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
         lambda c, b: list_reduce(range(8), lambda r, i: {_STEP}, xor(c, b)), 4294967295)) % 3 = 0 AS tampered FROM documents),
leaves AS (
  SELECT rid, doc_id, coalesce('=' || lang, '') AS g, {_LEAF("text")} AS leaf,
         CASE WHEN tampered THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_LEAF("text")} END AS changed FROM docs),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
up AS (
  SELECT 0 AS level, g, pos, leaf AS node FROM base
  UNION ALL
  SELECT level + 1, g, pos // {RUN}, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM up) WHERE n > 1 GROUP BY level, g, pos // {RUN}),
subroots AS (SELECT g, arg_max(node, level) AS subroot, max(level) AS levels, row_number() OVER (ORDER BY g) - 1 AS pos FROM up GROUP BY g),
top AS (
  SELECT 0 AS level, pos, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // {RUN}, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // {RUN}),
summit AS (SELECT arg_max(node, level) AS root, max(level) AS levels FROM top),
sides AS (
  SELECT a.level, a.g, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM (SELECT level, g, pos FROM up UNION ALL SELECT 1000 + level, '', pos FROM top) a
  JOIN (SELECT level, g, pos, node FROM up UNION ALL SELECT 1000 + level, '', pos, node FROM top) b
    ON a.level = b.level AND a.g = b.g AND a.pos // {RUN} = b.pos // {RUN}
  GROUP BY a.level, a.g, a.pos),
steps AS (
  SELECT rid, level, l, r FROM base JOIN subroots USING (g) JOIN sides
    ON sides.g = base.g AND sides.level < subroots.levels AND sides.pos = base.pos // ({RUN} ** sides.level)::BIGINT
  UNION ALL
  SELECT rid, level, l, r FROM base JOIN subroots USING (g) JOIN sides
    ON sides.level >= 1000 AND sides.level < 1000 + (SELECT levels FROM summit) AND sides.pos = subroots.pos // ({RUN} ** (sides.level - 1000))::BIGINT),
paths AS (SELECT rid, list(l || '|' || r ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS proof FROM steps GROUP BY rid),
folds AS (
  SELECT rid, doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(coalesce(path, []), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), changed) AS folded_root
  FROM base JOIN subroots USING (g) CROSS JOIN summit LEFT JOIN paths USING (rid))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
