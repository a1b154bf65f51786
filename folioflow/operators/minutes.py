"""Motions and votes read from printed minutes and from speech, by windows over lines. pages: meeting_id, page, line_no, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.references import canonical, identifiers, item_references
from folioflow.functions.text import join_lines, number_parts
from folioflow.sources.cuts import Cuts

#: How minutes print a motion, its outcome and the names of a vote; the words of a spoken motion and of what became of it.
MOVED = r"(?i)^(.+?)\s+moved,\s+seconded by\s*(.*?)\s*,\s*(to\s+.+)$"
COUNTED = r"(?i)^(Carried|Failed)\s*:\s*(\d+)\s*[–—−-]\s*(\d+)\s*$"
BARE = r"^\d+\s*[–—−-]\s*\d+\s*$"
LABELS = ["approved", "dissented", "abstained"]
WITHDRAWN, OPENS = "motion withdrawn", "motion"
PAGE_LINE, YEAR = r"(?i)^page\s+\d+\s*$", r"\b\d{4}\b"
SPOKEN_MOTION = r"(?i)\b(motion|moved|seconded)\b"
SPOKEN_FAILED, SPOKEN_PASSED = r"\b(denied|fails?|failed|does not carry)\b", r"\b(carr(?:ies|ied)|unanimous)\b"
#: Lines after a spoken motion in which its outcome is looked for, and lines that a motion is read from.
OUTCOME_LINES, MOTION_LINES = 24, 3


def running_heads(pages: DataFrame) -> DataFrame:
    """[AG14] meeting_id, text: lines with a year that stand on half of a meeting's pages (rounded up), two at least."""
    n = pages.groupBy("meeting_id").agg(F.count_distinct("page").alias("n"))
    line = F.trim("text")
    seen = pages.where(line.rlike(YEAR)).groupBy("meeting_id", line.alias("text")).agg(F.count_distinct("page").alias("seen"))
    return seen.join(n, "meeting_id").where(F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))).select("meeting_id", "text")


def _label(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^(.*?)\s*:$", 1))


def motions(pages: DataFrame) -> DataFrame:
    """[ST22] meeting_id, ordinal, page, mover, seconder, text, result, outcome, yes, no, approved, dissented, abstained.

    A motion begins at a mover's line and its text goes on to the first label, result or heading; a further mover's line
    before that is text. The first line of outcome tells the result; carried motions to table are tabled. A meeting's lines are
    one window partition, sorted once; blocks and motions are differences of running counts in that order, so no line is walked by hand."""
    lines = pages.select("meeting_id", "page", "line_no", F.trim("text").alias("text")).where(F.col("text") != "").where(~F.col("text").rlike(PAGE_LINE))
    lines = lines.join(running_heads(pages), ["meeting_id", "text"], "left_anti")
    t, low = F.col("text"), F.lower("text")
    kind = F.when(low == WITHDRAWN, "withdrawn").when(low == OPENS, "opens").when(_label(t).isin(LABELS), "label").when(t.rlike(COUNTED), "counted").when(t.rlike(BARE), "bare").when(t.rlike(MOVED), "moved").otherwise("other")
    order = Window.partitionBy("meeting_id").orderBy("page", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda test: F.sum(test.cast("int")).over(so_far)
    at_last = lambda test, c: F.last(F.when(test, c), ignorenulls=True).over(so_far)
    is_block, moved, other = F.col("kind").isin("withdrawn", "opens", "label", "counted"), F.col("kind") == "moved", F.col("kind").isin("other", "moved")
    marked = lines.withColumn("kind", kind).withColumns({"pos": F.row_number().over(order), "movers": count(moved), "blocks": count(is_block)})
    marked = marked.withColumns({"movers_before": at_last(is_block, F.col("movers")), "in_kind": at_last(is_block, F.col("kind"))})
    # the first mover's line after a block's line begins a motion; after a label it would be a name
    listed = F.coalesce(F.col("in_kind") == "label", F.lit(False))
    begins = moved & (F.col("movers") - F.coalesce("movers_before", F.lit(0)) == 1) & ~listed
    runs = marked.withColumn("begins", begins).withColumns({"motion": count(F.col("begins")), "blocks_before": at_last(F.col("begins"), F.col("blocks"))}).where("motion > 0")

    after = F.col("blocks") > F.col("blocks_before")
    of_motion = lambda test, c: at_last(test, F.struct("motion", c.alias("c")))
    x = runs.withColumns({"after": after, "last_head": of_motion(~other, F.col("kind")), "last_list": of_motion(F.col("kind") == "label", _label(t))})
    own = lambda c: F.when(F.col(c)["motion"] == F.col("motion"), F.col(c)["c"])
    x = x.withColumns({"head": own("last_head"), "list": own("last_list")})
    name = other & F.coalesce(F.col("head") == "label", F.lit(False))
    counts, ends = F.col("after") & (F.col("kind") == "counted"), F.col("after") & ((F.col("kind") == "opens") | (other & ~name))
    x = x.withColumns({"counts": counts.cast("int"), "n_counts": count(counts), "n_ends": count(ends)})
    x = x.withColumns({"counts_before": at_last(F.col("begins"), F.col("n_counts")), "ends_before": at_last(F.col("begins"), F.col("n_ends"))})
    # a motion stops after its count, or at a line that is no part of it
    told = F.col("after") & (F.col("n_counts") - F.col("counts") == F.col("counts_before")) & (F.col("n_ends") == F.col("ends_before"))
    spoken = F.col("begins") | ~F.col("after")
    piece = F.when(F.col("begins"), F.regexp_extract(t, MOVED, 3)).otherwise(t)
    outcome = F.when(told & F.col("kind").isin("withdrawn", "counted", "bare"), F.struct("pos", "kind", "text"))
    kept = lambda label: F.sort_array(F.collect_list(F.when(told & name & (F.col("list") == label), F.struct("pos", "text"))))
    grouped = x.groupBy("meeting_id", "motion").agg(
        F.min(F.when(F.col("begins"), F.struct("page", "text"))).alias("line"),
        F.sort_array(F.collect_list(F.when(spoken, F.struct("pos", piece.alias("piece"))))).alias("pieces"),
        F.min(outcome).alias("outcome"),
        *[kept(label).alias(label) for label in LABELS],
    )
    whole = grouped.withColumn("said", join_lines(F.transform("pieces", lambda p: p["piece"])))
    o = F.col("outcome")
    counted = F.lower(F.regexp_extract(o["text"], COUNTED, 1))
    result = F.when(o["kind"] == "withdrawn", "withdrawn").when(counted == "failed", "failed").when((counted == "carried") & F.col("said").rlike(r"(?i)^to\s+table\s"), "tabled").when(counted == "carried", "passed").otherwise("unknown")
    number = lambda k: F.when(o["kind"] == "counted", F.regexp_extract(o["text"], COUNTED, k).cast("int"))
    head = F.col("line.text")
    return whole.select("meeting_id", F.col("motion").cast("int").alias("ordinal"), "line.page", F.trim(F.regexp_extract(head, MOVED, 1)).alias("mover"), F.trim(F.regexp_extract(head, MOVED, 2)).alias("seconder"), F.col("said").alias("text"), result.alias("result"), F.coalesce(o["text"], F.lit("")).alias("outcome"), number(2).alias("yes"), number(3).alias("no"), *[_names(F.col(label)).alias(label) for label in LABELS])


def _names(lines: Column) -> Column:
    """Names at commas, semicolons and `and`; None is nobody."""
    whole = F.trim(F.array_join(F.transform(lines, lambda x: x["text"]), " "))
    parts = F.filter(F.transform(F.split(whole, r"(?i)[,;]|\band\b"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.lower(whole) == "none", F.array().cast("array<string>")).otherwise(parts)


def _items_named(said: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """meeting_id, key, item_no: items whose record number a text holds, or else (only where none does) whose item number it cites."""
    numbered = items.select("meeting_id", "item_no", F.explode(F.transform(identifiers("title"), canonical)).alias("c")).distinct()
    heard = said.select("meeting_id", *key, F.explode(F.transform(identifiers("text"), canonical)).alias("c")).distinct()
    by_record = heard.join(numbered, ["meeting_id", "c"]).select("meeting_id", *key, "item_no").distinct()
    parts = number_parts(F.col("number"))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.size(parts) - n + 1, n))
    known = items.where(F.size(parts) > 0).select("meeting_id", "item_no", F.explode(tails).alias("p"))
    cited = said.join(by_record, ["meeting_id", *key], "left_anti").select("meeting_id", *key, F.explode(item_references("text")).alias("r")).select("meeting_id", *key, F.col("r.parts").alias("p"))
    return by_record.unionByName(cited.join(known, ["meeting_id", "p"]).select("meeting_id", *key, "item_no").distinct())


def item_votes(read: DataFrame, items: DataFrame) -> DataFrame:
    """[CX5, WN15] meeting_id, item_no, ordinal, result, yes, no: what the minutes' last decided motion on each item says.

    Motions with the text of an earlier one are dropped; withdrawn and unknown ones decide nothing."""
    once = read.groupBy("meeting_id", "text").agg(F.min_by(F.struct("ordinal", "result", "yes", "no"), "ordinal").alias("x")).select("meeting_id", "text", "x.*")
    named = _items_named(once.where("result in ('passed', 'failed', 'tabled')"), items, ["ordinal"])
    votes = named.join(once.drop("text"), ["meeting_id", "ordinal"])
    return votes.groupBy("meeting_id", "item_no").agg(F.max_by(F.struct("ordinal", "result", "yes", "no"), "ordinal").alias("x")).select("meeting_id", "item_no", "x.*")


def spoken_result(text: Column) -> Column:
    """[ST24] Words of failure beat words of success."""
    return F.when(F.lower(text).rlike(SPOKEN_FAILED), "failed").when(F.lower(text).rlike(SPOKEN_PASSED), "passed").otherwise("unknown")


def spoken_votes(lines: DataFrame, items: DataFrame) -> DataFrame:
    """[CX6] meeting_id, item_no, start_ms, result, motion, outcome: the first spoken motion that names one item only, and what the chair
    says became of it in the next lines. A mention is never a count. lines: meeting_id, line_id, start_ms, text."""
    order = Window.partitionBy("meeting_id").orderBy("start_ms", "line_id")
    near = F.array_join(F.array("text", *[F.lead("text", k).over(order) for k in range(1, MOTION_LINES)]), " ")
    told = F.when(spoken_result(F.col("text")) != "unknown", F.trim("text"))
    placed = lines.select("meeting_id", "line_id", "start_ms", "text", F.row_number().over(order).alias("pos"), near.alias("near"))
    few = placed.withColumns({"told": told, "moved": F.coalesce(F.col("text").rlike(SPOKEN_MOTION), F.lit(False))}).where("moved or told is not null")
    ahead = Window.partitionBy("meeting_id").orderBy("pos").rangeBetween(MOTION_LINES, MOTION_LINES + OUTCOME_LINES - 1)
    said = few.withColumn("outcome", F.first("told", ignorenulls=True).over(ahead)).where("moved")
    motion = said.select("meeting_id", "line_id", "start_ms", F.col("near").alias("text"), F.coalesce("outcome", F.lit("")).alias("outcome"))
    motion = Cuts(lines.sparkSession, "spoken").write("motions", motion)  # it is read three times
    named = _items_named(motion, items, ["line_id"])
    single = named.groupBy("meeting_id", "line_id").agg(F.count("*").alias("n"), F.min("item_no").alias("item_no")).where("n = 1").drop("n")
    first = motion.join(single, ["meeting_id", "line_id"]).groupBy("meeting_id", "item_no").agg(F.min(F.struct("start_ms", "line_id", F.col("text").alias("motion"), "outcome")).alias("x"))
    return first.select("meeting_id", "item_no", "x.start_ms", spoken_result(F.col("x.outcome")).alias("result"), "x.motion", "x.outcome")


#: Offices that minutes print before names, with what they are called and their rank (null: the common one), the common office, and how many words a printed name may have.
OFFICES = {
    "mayor pro tem": ("Mayor Pro Tem", 2), "mayor": ("Mayor", 3), "council member": None, "councilmember": None, "councilman": None, "councilwoman": None,
}
COMMON_OFFICE, NAME_WORDS = "Council Member", 3
_NAME = rf"[A-Za-z][\w'’.\-]*(?:\s+[A-Za-z][\w'’.\-]*){{0,{NAME_WORDS - 1}}}"


def printed_offices(pages: DataFrame, people: DataFrame, offices: dict[str, tuple[str, int] | None] = OFFICES) -> DataFrame:
    """[ST23] meeting_id, name, office: the highest office that a meeting's pages print in front of each of its people; the common one if none.

    Offices are one pattern, the longest first, so that one which begins like another is read whole. A printed name is a person's if it begins with
    their last word, or with all their words: both are keys, so pages and people meet by equi joins in a meeting, not pair by pair.
    pages: meeting_id, text; people: meeting_id, name."""
    words = "|".join(r"\s+".join(o.split()) for o in sorted(offices, key=len, reverse=True))
    found = F.regexp_extract_all("text", F.lit(rf"(?iU)\b({words})\s+({_NAME})"), F.lit(1)), F.regexp_extract_all("text", F.lit(rf"(?iU)\b({words})\s+({_NAME})"), F.lit(2))
    lines = pages.select("meeting_id", F.explode(F.split("text", "\n")).alias("text"))
    seen = lines.select("meeting_id", F.explode(F.arrays_zip(found[0].alias("office"), found[1].alias("printed"))).alias("x"))
    ranked = {k: v for k, v in offices.items() if v}
    office = F.regexp_replace(F.lower("x.office"), r"\s+", " ")
    told = F.create_map(*[F.lit(y) for k, (called, rank) in ranked.items() for y in (k, f"{rank:09d}{called}")])[office]
    written = F.transform(F.split(F.lower("x.printed"), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", ""))
    keys = F.array_append(F.transform(F.sequence(F.lit(1), F.size("written")), lambda n: F.concat(F.lit("all "), F.array_join(F.slice("written", F.lit(1), n), " "))), F.concat(F.lit("last "), F.get("written", F.lit(0))))
    printed = seen.select("meeting_id", told.alias("told"), written.alias("written")).where("told is not null").select("meeting_id", "told", F.explode(F.array_distinct(keys)).alias("key")).distinct()
    own = F.filter(F.split(F.lower(F.trim("name")), r"\s+"), lambda w: w != "")
    known = people.select("meeting_id", "name").distinct()
    ways = known.withColumn("own", own).where("size(own) > 0").select("meeting_id", "name", F.explode(F.array(F.concat(F.lit("all "), F.array_join("own", " ")), F.concat(F.lit("last "), F.element_at("own", -1)))).alias("key"))
    best = ways.join(printed, ["meeting_id", "key"]).groupBy("meeting_id", "name").agg(F.substring(F.max("told"), 10, 1000).alias("office"))
    return known.join(best, ["meeting_id", "name"], "left").select("meeting_id", "name", F.coalesce("office", F.lit(COMMON_OFFICE)).alias("office"))
