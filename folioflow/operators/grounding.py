"""Sentences of answers checked against the evidence they cite. All rules are column expressions; evidence meets sentences by handle.

answers: answer_id, text. evidence: answer_id, handle ([E1], ...), kind (video, record, vote), text, yes, no. roster: surname."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations that end no sentence; answers that claim nothing; spelled numbers; curled quotation marks and the plain ones.
ABBREVIATIONS = "mr mrs ms dr prof st mt no sec art exh inc ltd co vs jr sr etc approx dept u.s u.s.a sept oct nov dec jan feb mar apr jun jul aug".split()
NOT_FOUND = ["not found", "not found in the record", "not in the record", "no record found", "not found in the archive", "record not available yet", "the record is not available yet"]
SPELLED = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety".split(), [*range(1, 21), *range(30, 100, 10)]))
CURLED, STRAIGHT = "“”„«»‘’‚", "\"\"\"\"\"'''"
TALLY = r"(?<![\w–—-])(\d{1,3})\s*[-–—]\s*(\d{1,3})(?![\d–—-])"
DIGITS = r"\d[\d,]*(?:\.\d+)?"


def folded(text: Column) -> Column:
    """White space collapsed and quotation marks straightened."""
    return F.trim(F.regexp_replace(F.translate(text, CURLED, STRAIGHT), r"\s+", " "))


def sentences(text: Column) -> Column:
    """[ST26] Sentences: cut after an end mark and white space; a piece that goes on in lower case or with a digit, or follows an abbreviation, is put back."""
    pieces = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda p: p != "")

    def goes_on(before: Column, piece: Column) -> Column:
        last = F.lower(F.regexp_extract(before, r"(\S*?)[.!?]$", 1))
        short = F.trim(F.regexp_replace(last, r"^\.+|\.+$", "")).isin(ABBREVIATIONS)
        return ~before.rlike("[.!?]$") | short | piece.rlike(r"^[\p{Ll}\d]")

    def add(done: Column, piece: Column) -> Column:
        last = F.element_at(done, F.size(done))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, piece)))
        return F.when(F.size(done) == 0, F.array(piece)).when(goes_on(last, piece), joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), add)


def handles(text: Column) -> Column:
    """[ST27] Handles like [E3], once each, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[E\d+\])"), F.lit(1)))


def _said(text: Column) -> Column:
    return folded(F.regexp_replace(text, r"\[E\d+\]", " "))


def quotes(text: Column) -> Column:
    """[ST27] Quoted passages, once each."""
    found = F.transform(F.regexp_extract_all(_said(text), F.lit('"([^"]*)"'), F.lit(1)), folded)
    return F.array_distinct(F.filter(found, lambda q: q != ""))


def tallies(text: Column) -> Column:
    """[ST27] Counted votes as yes-no."""
    found = F.regexp_extract_all(folded(text), F.lit(f"({TALLY})"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, r"^(\d+)\D+(\d+)$", "$1-$2"))


def numbers(text: Column, without_tallies: bool = False) -> Column:
    """[ST27] Numbers as digits, spelled ones too, sorted; a tally's own digits can be left out."""
    plain = _said(text)
    plain = F.regexp_replace(plain, TALLY, " ; ") if without_tallies else plain
    digits = F.transform(F.regexp_extract_all(plain, F.lit(f"({DIGITS})"), F.lit(1)), lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"\.+$", ""))
    words = F.regexp_extract_all(F.lower(plain), F.lit(rf"\b({'|'.join(SPELLED)})\b"), F.lit(1))
    value = F.create_map(*[F.lit(str(x)) for kv in SPELLED.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.concat(digits, F.transform(words, lambda w: value[w])), lambda n: n != "")))


def claims_nothing(text: Column) -> Column:
    return F.lower(F.regexp_replace(folded(text), r"[.!]+$", "")).isin(NOT_FOUND)


def check_sentences(answers: DataFrame, evidence: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """[ST29] answer_id, sentence_no, sentence, code: the first rule that a sentence breaks, else ok or not-found.

    Rules in order: it cites, what it cites is there, quotes stand word for word in it, a counted vote is that of a stored
    vote, other numbers and the roster's surnames stand in it. A sentence meets only the evidence it cites."""
    cut = answers.select("answer_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    packed = cut.join(evidence.groupBy("answer_id").agg(F.lit(True).alias("packed")), "answer_id", "left")
    asked = packed.select("answer_id", "sentence_no", F.explode(handles(F.col("sentence"))).alias("handle"))
    met = asked.join(evidence.select("answer_id", "handle", "kind", folded(F.col("text")).alias("span"), "yes", "no"), ["answer_id", "handle"], "left")
    counted = (F.col("kind") == "vote") & (F.col("yes").isNotNull() | F.col("no").isNotNull())
    cited = met.groupBy("answer_id", "sentence_no").agg(
        F.max(F.col("span").isNull()).alias("unknown"),
        F.collect_list("span").alias("spans"),
        F.collect_set(F.when(counted, F.concat_ws("-", "yes", "no"))).alias("votes"),
        F.collect_list(F.when(counted, F.concat_ws(" ", "yes", "no"))).alias("counts"),
    )
    x = packed.join(cited, ["answer_id", "sentence_no"], "left")
    s, none = F.col("sentence"), F.array().cast("array<string>")
    spans = F.coalesce("spans", none)
    known = numbers(F.concat_ws(" ; ", spans, F.coalesce("counts", none)))
    missing_quote = F.exists(quotes(s), lambda q: ~F.exists(spans, lambda t: F.contains(t, q)))
    wrong_tally = F.size(F.array_except(tallies(s), F.coalesce("votes", none))) > 0
    codes = (
        F.when(claims_nothing(s), "not-found")
        .when(F.col("packed").isNull(), "no-evidence")
        .when(F.size(handles(s)) == 0, "no-handle")
        .when(F.col("unknown"), "unknown-handle")
        .when(missing_quote, "quote-not-verbatim")
        .when((F.size(tallies(s)) > 0) & (F.size(F.coalesce("votes", none)) == 0), "tally-without-a-stored-vote")
        .when(wrong_tally, "tally-is-not-the-stored-vote")
        .when(F.size(F.array_except(numbers(s, True), known)) > 0, "number-not-in-evidence")
    )
    out = x.withColumn("code", codes)
    if roster is not None:
        word = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")))
        known_names = roster.select(F.lower("surname").alias("word")).distinct()
        named = out.where("code is null").select("answer_id", "sentence_no", word(_said(s)).alias("word")).join(known_names, "word")
        held = out.where("code is null").select("answer_id", "sentence_no", word(F.concat_ws(" ", spans)).alias("word"))
        faults = named.join(held, ["answer_id", "sentence_no", "word"], "left_anti").select("answer_id", "sentence_no").distinct().withColumn("fault", F.lit("name-not-in-evidence"))
        out = out.join(faults, ["answer_id", "sentence_no"], "left").withColumn("code", F.coalesce("code", "fault"))
    return out.select("answer_id", "sentence_no", "sentence", F.coalesce("code", F.lit("ok")).alias("code"))


def ground(checked: DataFrame, repaired: DataFrame, evidence: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """[ST30] answer_id, text, kept, repaired, removed: sentences that pass are kept; one that fails may be repaired once
    (repaired: answer_id, sentence_no, sentence), with the same quotes, tallies and numbers; else it is removed."""
    good = F.col("code").isin("ok", "not-found")
    tried = checked.where(~good).join(repaired.withColumnRenamed("sentence", "new"), ["answer_id", "sentence_no"])
    same = (quotes(F.col("sentence")) == quotes(F.col("new"))) & (tallies(F.col("sentence")) == tallies(F.col("new"))) & (numbers(F.col("sentence")) == numbers(F.col("new")))
    key = F.to_json(F.struct("answer_id", "sentence_no"))
    candidates = tried.where(same).select(key.alias("answer_id"), F.col("new").alias("text"), F.col("answer_id").alias("of"), "sentence_no", "new")
    spans = evidence.join(candidates.select(F.col("of").alias("answer_id"), F.col("answer_id").alias("key")), "answer_id").drop("answer_id").withColumnRenamed("key", "answer_id")
    passed = check_sentences(candidates.select("answer_id", "text"), spans, roster).groupBy("answer_id").agg(F.min(good).alias("fine")).where("fine")
    mended = candidates.join(passed, "answer_id", "left_semi").select(F.col("of").alias("answer_id"), "sentence_no", "new")
    whole = checked.join(mended, ["answer_id", "sentence_no"], "left")
    outcome = F.when(good, "kept").when(F.col("new").isNotNull(), "repaired").otherwise("removed")
    told = whole.withColumn("outcome", outcome).withColumn("final", F.when(good, F.col("sentence")).otherwise(F.col("new")))
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "repaired", "removed")]
    listed = F.array_sort(F.collect_list(F.when(F.col("final").isNotNull(), F.struct("sentence_no", "final"))))
    return told.groupBy("answer_id").agg(listed.alias("xs"), *counts).select("answer_id", F.array_join(F.transform("xs", lambda x: x["final"]), " ").alias("text"), "kept", "repaired", "removed")


def evidence_pack(lines: DataFrame, pages: DataFrame, votes: DataFrame, limit: int) -> DataFrame:
    """[ST31] meeting_id, handle, kind, source_id, text, dropped: lines, then pages, then votes (meeting_id, place, source_id, text), with
    stable handles, cut at the limit for each meeting; dropped tells how many rows the cut left out. Ranking keeps `limit` rows a meeting
    and task, so none is collected."""
    parts = [rows.select("meeting_id", F.lit(k).alias("kind_no"), F.lit(kind).alias("kind"), "place", "source_id", "text") for k, (kind, rows) in enumerate((("video", lines), ("record", pages), ("vote", votes)))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = Window.partitionBy("meeting_id").orderBy("kind_no", "place", "source_id")
    best = whole.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(0, limit))
    sizes = whole.groupBy("meeting_id").agg(F.greatest(F.lit(0), F.count("*") - max(0, limit)).alias("dropped"))
    return best.join(sizes, "meeting_id").select("meeting_id", F.format_string("[E%d]", "n").alias("handle"), "kind", "source_id", "text", "dropped")
