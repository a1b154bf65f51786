"""Operator 9: token counts that follow edits, by a segment tree over each document's pre-tokens."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bpe import BEYOND, NARROW, WIDE, Bpe, load, pieces, vocabulary_path
from folioflow.llm.common import Scratch, table

#: Pre-tokens of a leaf when a tree is built, and pre-tokens before an edit that are read again: white space before it can
#: be split otherwise once what follows changes.
LEAF = 32
CONTEXT = 2


class Counts(dict):
    """Pre-token to its number of tokens; forgets all when full."""

    def __init__(self, bpe: Bpe, limit: int = 300_000):
        super().__init__()
        self.bpe, self.limit = bpe, limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[piece] = n = len(self.bpe.encode(piece.encode("utf-8", "replace")))
        return n


@functools.cache
def _counts(path: str) -> Counts:
    return Counts(load(path))


def boundaries(bpe: Bpe, text: str, at: int = 0) -> Iterator[tuple[int, bool]]:
    """Ends of the pre-tokens from a boundary on, and whether each is a special string (which is one token, and ends a text for the split pattern)."""
    specials = bpe.split_special.finditer(text, at) if bpe.split_special else iter(())
    pattern = WIDE if BEYOND.search(text) else NARROW
    while at < len(text):
        special = next(specials, None)
        stop = special.start() if special else len(text)
        for m in pattern.finditer(text, at, stop):
            yield m.end(), False
        if special:
            yield special.end(), True
        at = special.end() if special else len(text)


class CountTree:
    """A text in leaves of pre-tokens, with the characters and tokens of each pre-token, and their sums in all inner nodes.

    An edit costs a walk from the root, the encoding of the pre-tokens that it changes and the sums above them: text outside
    the leaves it touches is neither read nor copied. A leaf of over 2 LEAF pre-tokens is split, and the inner sums are then
    made anew (once for LEAF new pre-tokens at most). A tree is loaded from its table row without encoding anything."""

    def __init__(self, counts: Counts, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.counts, self.encoded_chars = counts, 0
        self.base = text, chars, tokens, np.append(0, np.cumsum(chars))  # leaves are cut out of it when they are first touched
        self.leaves: list[tuple | int] = list(range(0, max(1, len(chars)), LEAF))
        sums = [np.add.reduceat(x, self.leaves) if len(x) else [0] for x in (chars, tokens)]
        self._sum(np.stack(sums, 1))

    @classmethod
    def build(cls, counts: Counts, text: str) -> CountTree:
        """Encodes the whole text."""
        return cls(counts, text, *_whole(counts, text))

    def _leaf(self, k: int) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, characters and tokens of the k-th leaf."""
        if isinstance(at := self.leaves[k], int):
            text, chars, tokens, ends = self.base
            stop = min(at + LEAF, len(chars))
            self.leaves[k] = text[ends[at] : ends[stop]], chars[at:stop], tokens[at:stop]
        return self.leaves[k]

    def _sum(self, of_leaves: np.ndarray) -> None:
        self.width = 1 << (len(of_leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(of_leaves)] = of_leaves
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level].reshape(half, 2, 2).sum(1)
            level = half

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def depth(self) -> int:
        return self.width.bit_length()

    def kept(self) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, characters and tokens of the pre-tokens: what a table keeps. Leaves that no edit touched come in stretches."""
        text, chars, tokens, ends = self.base
        parts, k = [], 0
        while k < len(self.leaves):
            if isinstance(at := self.leaves[k], int):
                while k < len(self.leaves) and isinstance(self.leaves[k], int):
                    stop, k = min(self.leaves[k] + LEAF, len(chars)), k + 1
                parts.append((text[ends[at] : ends[stop]], chars[at:stop], tokens[at:stop]))
            else:
                parts.append(self.leaves[k])
                k += 1
        return "".join(x[0] for x in parts), *(np.concatenate([x[i] for x in parts]) for i in (1, 2))

    @property
    def text(self) -> str:
        return self.kept()[0]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf with the character at this place (the last one with text beyond the end), and where the leaf starts."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.sums[node, 0] <= at and self.sums[node + 1, 0] > 0:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves[leaf] = text, chars, tokens
        node = self.width + leaf
        change = np.array([len(text), tokens.sum()]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def _back(self, at: int) -> tuple[int, int, int]:
        """Leaf, index in it and place of the pre-token that is CONTEXT before the one that holds the character before `at`."""
        leaf, start = self._leaf_at(max(0, at - 1))
        ends = start + np.cumsum(self._leaf(leaf)[1])
        k = min(int(np.searchsorted(ends, max(0, at - 1), side="right")), max(0, len(ends) - 1))
        place = int(ends[k - 1]) if k else start
        for _ in range(CONTEXT):
            while k == 0 and leaf > 0:
                leaf -= 1
                k = len(self._leaf(leaf)[1])
            if k == 0:
                break
            k -= 1
            place -= int(self._leaf(leaf)[1][k])
        return leaf, k, place

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts `new` in the place of the characters from start to stop.

        Read again from CONTEXT pre-tokens before any special string that the edit could make or break; the text after the
        edit is as before from the first place where an old and a new pre-token end together, that far beyond it."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        reach = max(map(len, self.counts.bpe.special), default=1)
        leaf, k, place = self._back(start - reach)
        head = self._leaf(leaf)
        kept = int(head[1][:k].sum())
        # leaves are joined until the pre-tokens meet again; from there on all is as before
        last, region = leaf, head[0][kept:]
        while True:
            end = place + len(region)
            more = last + 1 < len(self.leaves)
            if end >= stop + reach or not more:
                text = region[: start - place] + new + region[stop - place :]
                # the last pre-tokens before a cut could go on beyond it
                safe = len(text) if not more else len(text) - reach
                old = place + np.cumsum(np.concatenate([x[1] for x in [(None, head[1][k:]), *map(self._leaf, range(leaf + 1, last + 1))]]))
                meeting = set(old[old >= stop].tolist())
                shift, found, met = len(new) - (stop - start), [], None
                for at, special in boundaries(self.counts.bpe, text):
                    if at > safe:
                        break
                    found.append((at, special))
                    if at >= start - place + len(new) and at + place - shift in meeting:
                        met = at
                        break
                if met is not None or not more:
                    break
            last += 1
            region += self._leaf(last)[0]
        met = len(text) if met is None else met
        chars, tokens = _measured(self.counts, text[:met], found)
        self.encoded_chars += met
        rest = int(np.searchsorted(old, met + place - shift, side="right")) if len(old) else 0  # old pre-tokens that were read again
        old_chars = np.concatenate([head[1][k:], *[x[1] for x in map(self._leaf, range(leaf + 1, last + 1))]])[rest:]
        old_tokens = np.concatenate([head[2][k:], *[x[2] for x in map(self._leaf, range(leaf + 1, last + 1))]])[rest:]
        empty = np.zeros(0, np.int64)
        for i in range(leaf + 1, last + 1):
            self._set(i, "", empty, empty)
        self._set(leaf, head[0][:kept] + text, np.concatenate([head[1][:k], chars, old_chars]), np.concatenate([head[2][:k], tokens, old_tokens]))
        if len(self._leaf(leaf)[1]) > 2 * LEAF:
            self._split(leaf)

    def _split(self, leaf: int) -> None:
        text, chars, tokens = self._leaf(leaf)
        ends, fresh = np.append(0, np.cumsum(chars)), []
        for i in range(0, len(chars), LEAF):
            stop = min(i + LEAF, len(chars))
            fresh.append((text[ends[i] : ends[stop]], chars[i:stop], tokens[i:stop]))
        old = self.sums[self.width : self.width + len(self.leaves)]
        own = np.array([(len(t), n.sum()) for t, _, n in fresh], np.int64)
        self.leaves[leaf : leaf + 1] = fresh
        self._sum(np.concatenate([old[:leaf], own, old[leaf + 1 :]]))


def _measured(counts: Counts, text: str, ends: Iterable[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the pre-tokens with these ends."""
    chars, tokens, at = [], [], 0
    for end, special in ends:
        chars.append(end - at)
        tokens.append(1 if special else counts[text[at:end]])
        at = end
    return np.array(chars, np.int64), np.array(tokens, np.int64)


def _whole(counts: Counts, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of all pre-tokens of a text."""
    parts = []
    for part in counts.bpe.split_special.split(text) if counts.bpe.split_special else [text]:
        if part in counts.bpe.special:
            parts.append((np.array([len(part)], np.int64), np.ones(1, np.int64)))
        else:
            found = pieces(part)
            parts.append(tuple(np.fromiter(map(f, found), np.int64, len(found)) for f in (len, counts.__getitem__)))
    return tuple(np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in (0, 1))


def packed(numbers: np.ndarray) -> bytes:
    """One byte for the width, then little-endian numbers of it: of one byte where all fit."""
    width = 1 if numbers.max(initial=0) < 256 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


#: A kept tree: text, characters and tokens of its pre-tokens (packed), tokens now and when it was built, and what its edits had encoded.
TREE = "doc_id long, text string, chars binary, tokens binary, n_tokens long, built_tokens long, encoded_chars long, depth int"
_COLUMNS = [c.split()[0] for c in TREE.split(", ")]
#: Trees that a task hands on at once.
HANDED = 500


def count_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A tree (TREE) for each row of docs (doc_id, text), to be written as a table; edited() goes on from there.

    Null text is empty; rows without doc_id are counted like others; repeated rows each give a row; an empty table gives
    an empty result; extra columns are ignored; special strings are one token each."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _counts(path)
        for x in batches:
            for at in range(0, len(x), HANDED):
                out = []
                for doc_id, text in zip(x.doc_id.array[at : at + HANDED], x.text.array[at : at + HANDED]):
                    chars, tokens = _whole(counts, text)
                    n = int(tokens.sum())
                    out.append((doc_id, text, packed(chars), packed(tokens), n, n, 0, max(0, -(-len(chars) // LEAF) - 1).bit_length() + 1))
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, TREE)


def edited(trees: DataFrame, path: str | None = None) -> DataFrame:
    """The trees (TREE and the column edits) after their edits: only the pre-tokens that these touch are encoded.

    edits: array<struct<start, stop, text>>, applied in order; places are code points of the text as it then is, and places
    beyond its end mean its end. Null edits are none, a null replacement is empty."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _counts(path)
        for x in batches:
            for at in range(0, len(x), HANDED):
                out = []
                for doc_id, text, chars, tokens, built, encoded, edits in x.iloc[at : at + HANDED].itertuples(index=False, name=None):
                    tree = CountTree(counts, text, unpacked(chars), unpacked(tokens))
                    for e in edits if edits is not None else []:
                        tree.edit(e["start"], e["stop"], e["text"] or "")
                    new, *numbers = tree.kept()
                    out.append((doc_id, new, *map(packed, numbers), tree.n_tokens, built, encoded + tree.encoded_chars, tree.depth))
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})

    edits = F.col("edits").cast("array<struct<start:bigint,stop:bigint,text:string>>")
    return trees.select("doc_id", "text", "chars", "tokens", "built_tokens", "encoded_chars", edits.alias("edits")).mapInPandas(run, TREE)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the column edits from a table of edits (doc_id, seq, start, stop, text), in seq order."""
    row = F.struct("seq", "start", "stop", F.col("text").alias("new"))
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    plain = listed.select("doc_id", F.transform("rows", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), r["new"].alias("text"))).alias("edits"))
    return docs.select("doc_id", "text").join(plain, "doc_id", "left")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, and after three edits of its kept tree, which is read back from its table: a word put in at a third,
    ten characters replaced in the middle, ten cut near the end."""
    trees = Scratch(spark, "token-counts").write("trees", count_trees(table(spark, sf_dir, "documents")))
    n = F.length("text").cast("long")
    edit = lambda at, size, new: F.struct(at.cast("long").alias("start"), (at.cast("long") + size).alias("stop"), new.alias("text"))
    number = F.concat(F.lit(" no. "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    edits = F.array(edit(n / 3, 0, F.lit(" revised")), edit(n / 2, 10, number), edit(F.greatest(n - 20, F.lit(0)), 10, F.lit("")))
    done = edited(trees.withColumn("edits", edits))
    return done.select("doc_id", F.col("built_tokens").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("n_chars_edited"), "encoded_chars", "depth")
