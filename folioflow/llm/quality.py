"""Operator 6: quality classifier from weak labels: heuristic labellers, EM for their accuracies, a hashed linear scorer."""

from __future__ import annotations

import itertools
import math
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import HELD, Scratch, cut, sliced, table

#: Frequent function words of the languages met, whose share is high in prose.
FUNCTION_WORDS = "a al an and are as at avec be by con dans das de del den der des die du ein eine el en es et for from he im in is ist it la las le les los mit nicht of on or para por pour que qui se sich sie su sur that the this to un una und une von was with y zu".split()
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Hash slots of the scorer. Documents of a block, one step of the training (by hash of id and text), and the greatest number of
#: blocks: beyond, blocks grow, so that every document takes part in STEPS / BLOCKS steps at least.
SLOTS = 1 << 14
TRAIN_ROWS, BLOCKS = 4000, 100
#: Short texts are judged as if they had so many more words of no weight.
PRIOR_WORDS = 10
STEPS = 300

_NOISE = re.compile(r"[*#$%&@^~=+]{2,}|[!?]{2,}")
_SHAPE = [(re.compile("[^\\W\\d_a-zß-öø-ÿ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile(r"\d+"), "0")]
FUNCTION, SHOUT, NOISY, BAR, LONG, LINK, SIGN = (1 << i for i in range(7))


def traits(word: str) -> int:
    """Bits of what the labellers look at in a word."""
    bare = word.strip(".,;:!?()\"'").lower()
    return (
        FUNCTION * (bare in _FUNCTION)
        | SHOUT * (len(word) > 1 and word.isupper())
        | NOISY * bool(_NOISE.search(word))
        | BAR * (word in ("|", "||") or word.count("|") > 1)
        | LONG * (len(word) > 30)
        | LINK * ("http" in word or "www." in word)
        | SIGN * (not any(map(str.isalnum, word)))
    )


_FUNCTION = frozenset(FUNCTION_WORDS)


def shape(word: str) -> str:
    """The word with runs of capitals, small letters and digits as one sign each."""
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return word


#: The sign of every short code point: words of one outline have one shape.
_SIGNS = {c: shape(chr(c)) for c in range(256)}


class _Known(dict):
    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = self.make(word)
        return out


def votes(text: str, known: _Known) -> list[int]:
    """One vote of each labeller: ABSTAIN, BAD or GOOD."""
    words = text.split()
    return _votes(text, words, np.fromiter(map(known.__getitem__, words), np.uint8, len(words)))


def _votes(text: str, words: list[str], bits: np.ndarray) -> list[int]:
    n = len(words)
    if n == 0:
        return [BAD] * len(LABELLERS)
    share = {b: np.count_nonzero(bits & b) / n for b in (FUNCTION, SHOUT, NOISY, BAR, LONG, LINK, SIGN)}
    lines = [x for x in text.split("\n") if x]
    repeats = 1 - len(set(lines)) / max(1, len(lines))
    share["stutter"] = stutter(words) / n
    share["run"] = max(len(list(g)) for _, g in itertools.groupby(words)) if share["stutter"] else 1
    share["distinct"] = len(set(words)) / n
    return [f(share, repeats, n) for f in LABELLERS]


def stutter(words: list[str]) -> int:
    """How many words are the same as the word before."""
    return sum(map(operator.eq, words, words[1:]))


def _by(x: float, good: float, bad: float) -> int:
    """BAD above one bound, GOOD up to the other."""
    return BAD if x > bad else GOOD if x <= good else ABSTAIN


LABELLERS = [
    lambda s, r, n: _by(s[NOISY], 0.02, 0.15),
    lambda s, r, n: _by(s[SHOUT], 0.05, 0.25),
    lambda s, r, n: _by(s[BAR] + s[SIGN], 0.02, 0.15),
    lambda s, r, n: (GOOD if s[FUNCTION] >= 0.12 else BAD if s[FUNCTION] < 0.04 else ABSTAIN) if n >= 8 else ABSTAIN,
    lambda s, r, n: _by(r, 0.1, 0.4),
    lambda s, r, n: _by(s["stutter"], 0.01, 0.1),
    lambda s, r, n: _by(s["run"], 2, 4),
    lambda s, r, n: ABSTAIN if n < 20 else BAD if s["distinct"] < 0.2 else GOOD if s["distinct"] > 0.3 else ABSTAIN,
    lambda s, r, n: _by(s[LONG] + s[LINK], 0.02, 0.2),
]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P(good) of each pattern of votes (rows), from how often each occurs in the whole corpus.

    The labellers are taken as independent given the class; each has, for each class, a chance of voting bad where it doesn't
    abstain (which says nothing). The start breaks the symmetry: votes for bad need an extreme text, so one of them outweighs votes for good."""
    p = np.where((patterns == BAD).any(1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros_like(weight)
        for j in range(patterns.shape[1]):
            chance = np.stack([[w[patterns[:, j] == v].sum() for v in (BAD, GOOD)] for w in weight]) + 1.0
            log += np.c_[[0, 0], np.log(chance / chance.sum(1, keepdims=True))][:, patterns[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p


@dataclass
class Model:
    """Weights of hashed words, shapes and repeated words, as shares of a text's words and PRIOR_WORDS more, and a bias."""

    weights: np.ndarray
    bias: float

    def word(self, word: str, shapes: _Known) -> float:
        a, b = _slots(word, shapes)
        return float(self.weights[a] + self.weights[b])

    def score(self, words: list[str], known: _Known) -> float:
        if not words:
            return 0.0
        total = sum(map(known.__getitem__, words)) + self.weights[STUTTER] * stutter(words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total / (len(words) + PRIOR_WORDS) + self.bias))))


STUTTER = xxhash.xxh3_64_intdigest("stutter") % SLOTS


def _shape_slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest("shape " + shape(word)) % SLOTS


def _slots(word: str, shapes: _Known | None = None) -> list[int]:
    outline = word.translate(_SIGNS)
    return [xxhash.xxh3_64_intdigest(word.lower()) % SLOTS, _shape_slot(outline) if shapes is None else shapes[outline]]


def _slope(part: tuple, weights: np.ndarray, bias: float) -> np.ndarray:
    """Slope of the logistic loss by weight, and by the bias, over the documents of `_part`."""
    target, balance, row, slot, share = part
    z = np.bincount(row, weights[slot] * share, len(target)) + bias
    gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance
    return np.append(np.bincount(slot, gap[row] * share, SLOTS), gap.sum())


def _part(batch: pa.RecordBatch, good: dict[int, float], balance: tuple[float, float]) -> tuple:
    """P(good) and weight of each document of a batch; row, slot and share of each of their slots."""
    rows = batch.to_pydict()
    target = np.array([good[p] for p in rows["pattern"]])
    slot = np.frombuffer(b"".join(rows["slots"]), "<u2").astype(np.int64)
    row = np.repeat(np.arange(len(target)), [len(s) // 2 for s in rows["slots"]])
    share = np.frombuffer(b"".join(rows["counts"]), "<u4") / (np.array(rows["words"], np.int64) + PRIOR_WORDS)[row]
    return target, np.where(target >= 0.5, balance[0], balance[1]), row, slot, share


def train(slope_of: Callable[[int, np.ndarray, float], np.ndarray]) -> Model:
    """Logistic regression on soft labels by Adam; slope_of tells a step's slope (step from 0, weights, bias)."""
    weights, bias = np.zeros(SLOTS), 0.0
    m, v = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for step in range(1, STEPS + 1):
        slope = slope_of(step - 1, weights, bias) + np.append(1e-6 * weights, 0.0)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(weights, float(bias))


class _Words(_Known):
    """Numbers of words, with what the labellers look at (bits) and the two slots of each."""

    def __init__(self, limit: int = 300_000):
        super().__init__(self.add, limit)
        self.bits, self.slots, self.shapes = np.zeros(limit, np.uint8), np.zeros((2, limit), np.uint16), _Known(_shape_slot)

    def add(self, word: str) -> int:
        i = len(self)
        if i == len(self.bits):  # a text of more words than the limit
            self.bits, self.slots = np.concatenate([self.bits] * 2), np.concatenate([self.slots] * 2, 1)
        self.bits[i], self.slots[:, i] = traits(word), _slots(word, self.shapes)
        return i

    def __missing__(self, word: str) -> int:
        self[word] = i = self.add(word)
        return i

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) >= self.limit:  # between texts, so that a text's numbers stay good
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


FEATURES = "doc_id long, key long, pattern int, words int, slots binary, counts binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for b in sliced(batches):
        out = []
        for text in b["text"].to_pylist():
            words = text.split()
            ids = known.of(words)
            pattern = sum(v * 3**j for j, v in enumerate(_votes(text, words, known.bits[ids])))
            slots, counts = np.unique(np.append(known.slots[:, ids], np.full(stutter(words), STUTTER, np.uint16)), return_counts=True)
            out.append((pattern, len(words), slots.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
        found = zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], *[pa.array(x, kind) for x, kind in found]], ["doc_id", "key", "pattern", "words", "slots", "counts"])


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The scorer, and doc_id, key, pattern, posterior of every row. All documents count for the labellers' accuracies, and
    all train the scorer, rows equal in doc_id and text once.

    Documents are dealt by hash to blocks of about TRAIN_ROWS, at most BLOCKS; each step of the training takes the slope over one whole
    block, block after block. The slope is summed in tasks over the block's stored features; the driver gets one vector of SLOTS
    a task. A corpus of at most TRAIN_ROWS rows is one block, whose features are held for all steps."""
    spark = docs.sparkSession
    blocks = max(1, min(BLOCKS, -(-docs.count() // TRAIN_ROWS)))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks)).cast("int")
    dealt = _rows(docs).mapInArrow(_features, FEATURES).withColumn("block", block).repartitionById(blocks, F.col("block"))
    once = dealt.groupBy("block", "doc_id", "key").agg(*[F.first(c).alias(c) for c in ("pattern", "words", "slots", "counts")], F.count("*").alias("times"))
    scratch = Scratch(spark, "quality")
    kept = scratch.write("features", once, "block")
    found = kept.groupBy("pattern").agg(F.sum("times").alias("count"), F.count("*").alias("once")).orderBy("pattern").collect()  # at most 3 ** labellers rows
    if not found:
        return Model(np.zeros(SLOTS), 20.0), kept.select("doc_id", "key", "pattern", F.lit(1.0).alias("posterior"))
    codes = np.array([r["pattern"] for r in found], np.int64)
    patterns = np.stack([codes // 3**j % 3 for j in range(len(LABELLERS))], 1)
    good = dict(zip(codes.tolist(), expectation_maximisation(patterns, np.array([r["count"] for r in found], float)).tolist()))
    sure = sum(r["once"] for r in found if good[r["pattern"]] >= 0.5)
    balance = 0.5 * blocks / max(1, sure), 0.5 * blocks / max(1, sum(r["once"] for r in found) - sure)
    columns = kept.select("block", "pattern", "words", "slots", "counts")
    if blocks == 1:
        parts = [_part(b, good, balance) for b in columns.toArrow().to_batches() if b.num_rows]
        model = train(lambda step, weights, bias: sum(_slope(p, weights, bias) for p in parts))
    else:
        model = train(lambda step, weights, bias: _block_slope(columns.where(F.col("block") == step % blocks), good, balance, weights, bias))
    known = spark.createDataFrame(list(good.items()), "pattern int, posterior double")
    rows = cut(kept.select("doc_id", "key", "pattern", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col"))
    scratch.drop("features")
    return model, rows.join(F.broadcast(known), "pattern").select("doc_id", "key", "pattern", "posterior")  # at most 3 ** labellers rows


def _block_slope(block: DataFrame, good: dict[int, float], balance: tuple[float, float], weights: np.ndarray, bias: float) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1)
        for b in sliced(batches):
            total += _slope(_part(b, good, balance), weights, bias)
        yield pa.RecordBatch.from_pydict({"slope": [total.tobytes()]})

    return sum((np.frombuffer(r["slope"]) for r in block.mapInArrow(add, "slope binary").collect()), np.zeros(SLOTS + 1))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _scorer(model: Model):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes = _Known(_shape_slot)
        known = _Known(lambda word: model.word(word, shapes))
        for texts in batches:
            held = (texts.slice(at, HELD).to_pylist() for at in range(0, len(texts), HELD))
            yield pa.array([model.score(t.split(), known) for part in held for t in part], pa.float64())

    return score(F.coalesce(F.col("text"), F.lit("")))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the scorer finds good."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), _scorer(model).alias("score")).where("score >= 0.5").select("row.*")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, score (P(good)), keep for every row of docs.

    A null or blank text has score near 0 and isn't kept; rows without doc_id are scored like others; repeated rows get the
    same score; an empty table gives an empty result; extra columns are ignored; whole texts are read, of any length."""
    model, _ = fit(docs)
    return docs.select("doc_id", _scorer(model).alias("score")).withColumn("keep", F.col("score") >= 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
