"""Operator 5: canonical exact digests of documents."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, in_order, partitions_for, range_starts, table

#: Digests (8 bytes each) of repeated texts that are sent to all tasks; if there are more, they are joined by merging.
BROADCAST = 1 << 20


def canonical(text: str) -> bytes:
    """NFKC, case folded, NFKC again, runs of white space as one blank, none at the ends; in UTF-8."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes, bits: int = 128) -> str:
    return f"{xxhash.xxh3_128_intdigest(data) >> (128 - bits):032x}"


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The fingerprint is the 128-bit xxh3 digest of the canonical text. Inside buckets of equal digests the canonical
    bytes are compared; where they differ, each class but the first gets a suffix, in both fingerprint columns, so equal
    fingerprints of texts mean equal canonical texts. near_*: 1.0 where the canonical bytes are equal, else 0.0 (an exact
    digest has nothing between). The next document is by ascending (doc_id, text), after the last the first. Null text is
    empty; rows without doc_id come first; repeated rows each give a row; an empty table gives an empty result; extra
    columns are ignored. `bits` shortens the digest (tests force collisions by it)."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = scratch.write("found", _in_turn(docs, bits, False))
    # only digests that occur again are compared; a bucket's bytes are made distinct where they are read, so a bucket of any size is sent on once a task
    again = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("fingerprint").alias("h"))
    several = scratch.write("several", again)
    known = F.broadcast(several) if several.count() <= BROADCAST else several.hint("merge")
    rows = _digests(docs, bits).withColumn("h", F.xxhash64("fingerprint")).join(known, "h", "left_semi").drop("h").distinct()
    mixed = scratch.write("mixed", rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    if not mixed.isEmpty():
        found = _with_classes(scratch.write("whole", _in_turn(docs, bits, True)))
    return found.select(*COLUMNS)


def _with_classes(whole: DataFrame) -> DataFrame:
    """Fingerprints with a suffix for each class but the first of different bytes under one digest. Only reached when digests collide."""
    both = whole.select("fingerprint", "own").unionByName(whole.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_own").alias("own"))).distinct()
    per = both.groupBy("fingerprint").agg(F.array_sort(F.collect_set("own")).alias("owns")).where(F.size("owns") > 1)
    classes = per.select("fingerprint", F.posexplode("owns").alias("class", "own")).where("class > 0")
    named = classes.select("fingerprint", "own", F.concat_ws("-", "fingerprint", "class").alias("name"))
    for print_, own in (("fingerprint", "own"), ("edited_fingerprint", "edited_own")):
        marks = named.select(F.col("fingerprint").alias(print_), F.col("own").alias(own), "name")
        whole = whole.join(marks, [print_, own], "left").withColumn(print_, F.coalesce("name", print_)).drop("name")
    return whole


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _in_turn(docs: DataFrame, bits: int, with_bytes: bool) -> DataFrame:
    """SCHEMA for each row, which meets the next one in the order of (doc_id, text); with_bytes: also own and edited_own, the canonical bytes."""
    starts = range_starts(docs, "doc_id", partitions_for(docs.sparkSession))
    rows = in_order(docs, "doc_id", ["text"], starts, heads=True).select("doc_id", "text", "head")
    columns = COLUMNS + ["own", "edited_own"] * with_bytes

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        ended = False
        for batch in batches:
            out = []
            for doc_id, text, head in zip(batch.doc_id.array, batch.text.array, batch["head"].array):
                if ended:
                    break
                own = canonical(text)
                if held is not None:
                    was_id, was, was_own = held
                    new = edit(was, text)
                    new_own = canonical(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    told = (was_id, len(was), sha, digest(was_own, bits), digest(new_own, bits), float(was_own == new_own), float(was_own == own))
                    out.append(told + (was_own, new_own) * with_bytes)
                held = (doc_id, text, own)
                ended = bool(head)
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return rows.mapInPandas(per_partition, SCHEMA + ", own binary, edited_own binary" * with_bytes)


def _digests(docs: DataFrame, bits: int) -> DataFrame:
    """fingerprint and canonical bytes of each row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [canonical(t) for t in batch.text.array]
            yield pd.DataFrame({"fingerprint": [digest(x, bits) for x in own], "own": own})

    return docs.select("text").mapInPandas(rows, "fingerprint string, own binary")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
