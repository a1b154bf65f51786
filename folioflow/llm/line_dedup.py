"""Operator 10: removal of repeated runs of lines, found by seeds whose ends depend on their own lines only. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, as_rows, table, text_key

#: A boundary follows a line where the rolling hash of it and the line before is divisible by this.
DIVISOR = 2
#: A line of at least so many blanks-separated words is a passage: a chunk of its own.
PASSAGE_WORDS = 30
#: A run of fewer words is never removed, however many lines it has. (A line has one word at least, so a seed has so many lines at most.)
LEAST_WORDS = 8
#: A seed is one number: its first line times this, and how many lines it has.
SHIFT = 16
#: Stands for a missing doc_id in the order of documents.
ABSENT = -(2**63)


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _previous(a: str, i: Column, default: Column) -> Column:
    return F.when(i > 0, F.element_at(a, F.greatest(i, F.lit(1)))).otherwise(default)


def with_chunks(texts: DataFrame) -> DataFrame:
    """Adds _lines and _starts (1-based) to a table of the library's own with the column text: the text's lines, and where its chunks start.

    The hash of each line is rolled over the line before it; where the result is divisible by DIVISOR a chunk ends. A
    passage line stands alone. So lines put in or taken out elsewhere shift no boundary. The chunks joined by line feeds
    are the text. Time is in proportion to the lines."""
    step = texts.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    step = step.withColumn("_h", F.transform("_lines", lambda x: F.xxhash64(x)))
    step = step.withColumn("_big", F.transform("_lines", lambda x: _words(x) >= PASSAGE_WORDS))

    def opens(i: Column) -> Column:  # a line opens a chunk if it is first or a passage, follows a passage, or follows a line whose rolled hash says so
        before = _previous("_h", i, F.lit(0).cast("long"))
        earlier = _previous("_h", i - 1, F.lit(0).cast("long"))
        return (i == 0) | F.element_at("_big", i + 1) | _previous("_big", i, F.lit(True)) | (F.pmod(F.xxhash64(earlier, before), F.lit(DIVISOR)) == 0)

    starts = F.filter(F.transform("_h", lambda h, i: F.when(opens(i), i + 1)), lambda x: x.isNotNull())
    return step.withColumn("_starts", starts).drop("_h", "_big")


def _seeds(docs: DataFrame) -> DataFrame:
    """Adds _seeds array<struct<k, n, h, g>> to docs: the first line, the length in lines and two hashes of each seed.

    Seeds are the passage lines, and for each line the shortest run of at least two lines and LEAST_WORDS that starts there, and
    the shortest that ends there. They depend on no line outside. Each line of a run of two lines and LEAST_WORDS is in a seed
    inside the run, so equal runs have equal seeds that cover them. Two passage lines make no seed: each is one."""
    step = docs.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    step = step.withColumn("_w", F.transform("_lines", _words)).withColumn("_h", F.transform("_lines", lambda x: F.xxhash64(x))).withColumn("_g", F.transform("_lines", lambda x: F.xxhash64(F.lit(7), x)))

    def lines(w: Column, i: Column, way: int) -> Column:
        """Of the shortest run from line i on or back; null if the text ends before."""
        total, n = w, F.lit(None).cast("long")
        sums = [total := total + F.get("_w", i + way * k) for k in range(1, LEAST_WORDS)]
        for k in range(LEAST_WORDS - 1, 0, -1):
            n = F.when(sums[k - 1] >= LEAST_WORDS, F.lit(k + 1).cast("long")).otherwise(n)
        return F.when((w < PASSAGE_WORDS) | (F.get("_w", i + way) < PASSAGE_WORDS), n)

    on = F.transform("_w", lambda w, i: i * F.lit(SHIFT).cast("long") + lines(w, i, 1))
    back = F.transform("_w", lambda w, i: F.transform(F.array(lines(w, i, -1)), lambda n: (i - n + 1) * F.lit(SHIFT).cast("long") + n)[0])
    alone = F.transform("_w", lambda w, i: F.when(w >= PASSAGE_WORDS, i * F.lit(SHIFT).cast("long") + 1))
    step = step.withColumn("_at", F.array_distinct(F.filter(F.concat(on, back, alone), lambda x: x.isNotNull())))

    def seed(x: Column) -> Column:
        k, n = F.shiftright(x, 4).cast("int"), F.pmod(x, F.lit(SHIFT)).cast("int")
        return F.struct(k.alias("k"), n.alias("n"), F.xxhash64(F.slice("_h", k + 1, n)).alias("h"), F.xxhash64(F.slice("_g", k + 1, n)).alias("g"))

    return step.withColumn("_seeds", F.transform("_at", seed)).drop("_lines", "_w", "_h", "_g", "_at")


def _decided(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_id, _key, _dup array<struct<k, n>>: for each text (by doc_id and hash) the seeds that go; texts that lose none aren't listed."""
    absent = F.lit(ABSENT)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), absent).alias("_id"), text_key().alias("_key"), "text")
    spread = _seeds(own).select("_id", "_key", F.explode_outer("_seeds").alias("c")).where("c is not null").select("_id", "_key", "c.*")  # outer: else a filter on the array repeats all its steps
    spread = scratch.write("seeds", spread)
    place = F.struct("_id", "_key", "k")
    groups = spread.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "g", "first")
    overlaps = (F.col("_id") == F.col("first._id")) & (F.col("_key") == F.col("first._key")) & (F.col("k") < F.col("first.k") + F.col("n"))
    repeats = scratch.write("repeats", spread.join(groups, ["h", "g"]).select("_id", "_key", "k", "n", "h", "g", overlaps.alias("stays")))
    scratch.drop("seeds")

    # joined by merging at every size: what is joined to the texts grows with them, so it's never broadcast
    listed = repeats.groupBy("_id", "_key").agg(F.collect_set(F.struct("k", "n", "h", "g")).alias("_all"))
    lines = own.hint("merge").join(listed, ["_id", "_key"]).select(F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"), F.explode("_all").alias("d"))
    runs = lines.select("d.h", "d.g", F.array_join(F.slice("_lines", F.col("d.k") + 1, F.col("d.n")), "\n").alias("run"))
    unequal = scratch.write("unequal", runs.groupBy("h", "g").agg(F.min("run").alias("lo"), F.max("run").alias("hi")).where("lo <> hi").select("h", "g"))  # hash collisions
    going = repeats.where("not stays").join(unequal, ["h", "g"], "left_anti")
    decided = scratch.write("decided", going.groupBy("_id", "_key").agg(F.collect_set(F.struct("k", "n")).alias("_dup")))
    scratch.drop("repeats", "unequal")
    return decided


def dedup_lines(docs: DataFrame) -> DataFrame:
    """row (struct: the columns of docs), text, n_chunks, n_removed for every row: repeated runs of lines are taken out of text.

    A run is a passage line of PASSAGE_WORDS, or at least two lines with LEAST_WORDS together. A run that equals an
    earlier one, in the order (doc_id, text hash, position), goes whole, but not lines that overlap their first place. So
    the first place of every line stays; a line that is neither a passage nor beside a repeated line stays too. Runs are found by
    their seeds (see _seeds), grouped by two 64-bit hashes; a group whose bytes are not all equal (compared as a
    whole by their minimum and maximum) is left alone. n_chunks counts the text's chunks, n_removed those that lost lines.

    All rows are kept: a text of which nothing is left is empty, a null text stays null; rows without doc_id come first;
    repeated rows are copies (equal rows of one doc_id count as one document, so neither loses more than the other); an
    empty table gives an empty result; extra columns of any name stay in row."""
    decided = _decided(docs, Scratch(docs.sparkSession, "line-dedup"))
    rows = as_rows(docs).select("row", F.coalesce("i", F.lit(ABSENT)).alias("_id"), F.col("k").alias("_key"))
    whole = with_chunks(rows.hint("merge").join(decided, ["_id", "_key"], "left").withColumn("text", F.col("row.text")))
    gone = F.array_distinct(F.flatten(F.transform(F.coalesce("_dup", F.array()), lambda d: F.sequence(d["k"], d["k"] + d["n"] - 1))))
    out = whole.withColumn("_gone", gone)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    new_text = F.when(F.col("text").isNull() | (F.size("_gone") == 0), F.col("text")).otherwise(F.array_join(left, "\n"))
    stops = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_lines") + 1))
    chunk_of = F.flatten(F.zip_with("_starts", stops, lambda s, e: F.array_repeat(s, e - s)))
    n_removed = F.when(F.size("_gone") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.transform("_gone", lambda i: F.get(chunk_of, i)))))
    return out.select("row", new_text.alias("text"), F.size("_starts").alias("n_chunks"), n_removed.alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated runs of lines taken out of text, all other columns as they are but n_chars (if there is one), which
    follows a text that lost lines."""
    out, length = dedup_lines(docs), F.length("text").cast("long")
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "text", "n_chunks", "n_removed")
