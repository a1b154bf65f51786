"""Operator 3: byte-level BPE by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

#: The split pattern of the vocabulary's pre-tokeniser, and the printable bytes of its alphabet.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_SPACE = "\t-\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The same splits for texts whose characters all lie below U+0250; several times faster.
NARROW = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
WIDE = regex.compile(PATTERN)
BEYOND = re.compile("[ɐ-\U0010ffff]")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text."""
    return (WIDE if BEYOND.search(text) else NARROW).findall(text)


def alphabet() -> dict[str, int]:
    """Character of the vocabulary's alphabet to its byte: printable bytes stand for themselves, the others follow from U+0100."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary file. ids are re-encoded as ranks (bytes first, then merges in order) inside encode()."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = alphabet()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = sorted(byte, key=lambda c: byte[c]) + [a + b for a, b in merges]
        rank = {}
        for name in names:
            rank.setdefault(name, len(rank))
        self.bytes = [bytes(byte[c] for c in name) for name in rank]
        self.to_id = [vocab[name] for name in rank]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            self.pair.setdefault((rank[a], rank[b]), rank[a + b])
        of_bytes = {b: r for r, b in enumerate(self.bytes)}
        self.shorter = [next((of_bytes[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in of_bytes), -1) for b in self.bytes]
        self.length = [len(b) for b in self.bytes]
        self.machine = ahocorasick.Automaton()
        for r, b in enumerate(self.bytes):
            self.machine.add_word(b.decode("latin-1"), r)
        self.machine.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        of_id = dict(zip(self.to_id, self.bytes)) | {i: s.encode() for s, i in self.special.items()}
        flat = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.offsets = np.cumsum([0, *map(len, flat)])
        self.flat = np.frombuffer(b"".join(flat), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two. Kept in a table once known."""
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """By the definition: the joined bytes are merged, the earliest merge first and of equal ones the leftmost; no merge may join the border."""
        parts, border = [*self.bytes[left], *self.bytes[right]], len(self.bytes[left])  # the rank of a byte is the byte
        while True:
            merges = [(r, k) for k, p in enumerate(zip(parts, parts[1:])) if (r := self.pair.get(p)) is not None]
            if not merges:
                return parts == [left, right]
            rank, k = min(merges)
            if k + 1 == border:
                return False
            parts[k : k + 2] = [rank]
            border -= k + 1 < border

    def encode(self, data: bytes) -> list[int]:
        """Ranks of the exact merges of one pre-token: each position and token is tried at most once."""
        n = len(data)
        longest = [0] * n
        length = self.length
        for end, r in self.machine.iter(data.decode("latin-1")):
            start = end + 1 - length[r]
            if length[r] >= length[longest[start]] or not longest[start]:
                longest[start] = r
        if n and length[longest[0]] == n:
            return [longest[0]]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + length[token]] or out and not self.compatible(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text; special strings stand for themselves."""
        known: dict[str, list[int]] = {}
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in pieces(part):
                if piece not in known:
                    known[piece] = [self.to_id[r] for r in self.encode(piece.encode("utf-8", "replace"))]
                out += known[piece]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: their byte ranges in the offset table, copied one after the other; broken UTF-8 is replaced."""
        start, n = self.offsets[ids], self.offsets[np.asarray(ids) + 1] - self.offsets[ids]
        total = int(n.sum())
        first = np.cumsum(n) - n
        at = np.repeat(start - first, n) + np.arange(total)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


class Pieces(dict):
    """Pre-token to (its ids as little-endian uint32, its decimal ids joined by commas); forgets all when full."""

    def __init__(self, bpe: Bpe, limit: int = 250_000):
        super().__init__()
        self.bpe, self.limit = bpe, limit

    def __missing__(self, piece: str) -> tuple[bytes, str]:
        if len(self) >= self.limit:
            self.clear()
        ids = [self.bpe.to_id[r] for r in self.bpe.encode(piece.encode("utf-8", "replace"))]
        self[piece] = out = (np.array(ids, "<u4").tobytes(), ",".join(map(str, ids)))
        return out


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(load(path))


SCHEMA = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Per row of docs: doc_id, ids (little-endian uint32 bytes), n_tokens, and digests of the ids and the decoded text.

    Runs inside each partition, with no shuffle. Null text is empty (no ids); a null doc_id stays null; repeated rows
    each give a row; an empty table gives an empty result; extra columns are ignored. Texts of any length are encoded
    whole, in time in proportion to their length. keep_ids=False leaves the ids out of the result."""
    path = path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, known = load(path), _pieces(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id.array, batch.text.array):
                found = []
                for part in bpe.split_special.split(text) if bpe.split_special else [text]:
                    if part in bpe.special:
                        i = bpe.special[part]
                        found.append((np.array([i], "<u4").tobytes(), str(i)))
                    else:
                        found += map(known.__getitem__, pieces(part))
                raw = b"".join([x for x, _ in found])
                listed = ",".join([y for _, y in found])
                decoded = bpe.decode(np.frombuffer(raw, "<u4")).encode("utf-8")
                out.append((doc_id, raw if keep_ids else b"", len(raw) // 4, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, SCHEMA)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
