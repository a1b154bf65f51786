"""Agenda items placed in a transcript: candidates by equi joins, the longest chain in order, an offset from anchors for published times.

items: meeting_id, item_no (agenda order), number, title, seconds (published time or null).
lines: meeting_id, line_id, start_ms, end_ms, text. videos: meeting_id, duration_ms (null: not known; the last line's end counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.references import identifiers, item_references
from folioflow.functions.text import number_parts, significant_words, spoken_words
from folioflow.operators.temporal import agreed_offset, last_in_order, with_ends
from folioflow.sources.cuts import Cuts

#: Kinds of evidence, the strongest first.
SPOKEN_NUMBER, ITEM_NUMBER, WRITTEN_NUMBER, TITLE = 1, 2, 3, 4
#: Words by which a chair moves on.
MOVES = ["(?:now|move|moving|go|going|turn|turning)\\s+on\\s+to", "(?:move|moving|go|going|turn|turning)\\s+to", "(?:first|next)\\s+item(?:\\s+(?:for|of)\\s+(?:discussion|business))?(?:\\s+(?:will\\s+be|is))?", "next\\s+up(?:\\s+is)?"]
CUE = rf"(?i)\b(?:{'|'.join(MOVES)})\b"
#: Seconds after a cue in which an announced title is read on; around a published time in which the item must be mentioned; and by which anchors may differ.
ANNOUNCED_MS, MENTION_MS, TOLERANCE_S, LEAST_ANCHORS = 15_000, 20_000, 30.0, 3
LEAST_TITLE_WORDS = 2


def _readings(title: Column) -> Column:
    """The significant words of each way to announce a title: whole, or either side of a dash; notes in brackets aren't read out."""
    plain = F.regexp_replace(title, r"\([^)]*\)", " ")
    sides = F.array_distinct(F.concat(F.array(plain), F.split(plain, r"\s-\s|[–—]")))
    return F.filter(F.transform(sides, lambda s: significant_words(s)), lambda w: F.size(w) >= LEAST_TITLE_WORDS)


def _features(items: DataFrame, lines: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """What is read from each item and each line, once, as tables."""
    title = F.col("title")
    item = items.select("meeting_id", "item_no", "number", "title", "seconds", number_parts(F.col("number")).alias("parts"), significant_words(title).alias("title_words"), _readings(title).alias("readings"), identifiers("title").alias("ids"))
    line = lines.select("meeting_id", "line_id", "start_ms", "end_ms", "text", F.array_distinct(spoken_words(F.col("text"))).alias("words"), identifiers("text").alias("ids"), item_references("text").alias("refs"), F.regexp_instr("text", F.lit(CUE)).alias("cue"))
    return cuts.write("items", item), cuts.write("lines", line)


def _keys_of_items(item: DataFrame) -> DataFrame:
    """meeting_id, item_no, title_words, key, kind, needed: what a line may share with an item."""
    first = F.filter("ids", lambda x, i: ~F.exists(F.slice("ids", F.lit(1), i), lambda y: (y["year"] == x["year"]) & (y["number"] == x["number"])))
    # an item answers to each tail of its parts; a number alone only to the item that has no other part
    tails = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.slice("parts", F.size("parts") - n + 1, n))
    tails = F.filter(F.when(F.size("parts") > 0, tails).otherwise(F.array()), lambda t: (F.size(t) > 1) | ~t[0].rlike("^[0-9]+$") | (F.size("parts") == 1))
    needed = F.size("title_words")
    words = F.when(needed >= LEAST_TITLE_WORDS, F.col("title_words")).otherwise(F.array())
    key = lambda k, kind=None, n=None: F.struct(k.alias("key"), F.lit(None).cast("string").alias("kind") if kind is None else kind.alias("kind"), F.lit(0).alias("needed") if n is None else n.alias("needed"))
    keys = F.concat(F.transform(first, lambda i: key(_number_key(i), i["kind"])), F.transform(tails, lambda t: key(F.concat(F.lit("r|"), F.array_join(t, "|")))), F.transform(words, lambda w: key(F.concat(F.lit("w|"), w), n=needed)))
    return item.select("meeting_id", "item_no", "title_words", F.explode(keys).alias("x")).select("meeting_id", "item_no", "title_words", "x.*")


def _keys_of_lines(line: DataFrame) -> DataFrame:
    """meeting_id, line_id, start_ms, words, key, said_kind, letter, said: of what a line says, what an item may share."""
    none = F.lit(None).cast("string")
    key = lambda k, kind=none, letter=none, said=none: F.struct(k.alias("key"), kind.alias("said_kind"), letter.alias("letter"), said.alias("said"))
    numbers = F.transform("ids", lambda i: key(_number_key(i), i["kind"], i["letter"], i["text"]))
    keys = F.concat(numbers, F.transform("refs", lambda r: key(F.concat(F.lit("r|"), F.array_join(r["parts"], "|")), said=r["text"])), F.transform("words", lambda w: key(F.concat(F.lit("w|"), w))))
    # a line's words are needed beside a written number only
    return line.select("meeting_id", "line_id", "start_ms", F.when(F.exists("ids", lambda i: i["letter"].isNotNull()), F.col("words")).alias("words"), F.explode(keys).alias("x")).select("meeting_id", "line_id", "start_ms", "words", "x.*")


def _number_key(i: Column) -> Column:
    return F.concat_ws("|", F.lit("i"), i["year"].cast("string"), i["number"].cast("string"))


def candidates(item: DataFrame, line: DataFrame) -> DataFrame:
    """meeting_id, item_no, start_ms, rule, said: the places in the transcript that name an item; from the features of items and lines.

    Record numbers, item numbers and words are one kind of key, joined once within a meeting, so only places that share one meet. Of
    a line's evidence for an item the strongest counts."""
    met = _keys_of_items(item).join(_keys_of_lines(line), ["meeting_id", "key"])
    is_number, is_word = F.startswith("key", F.lit("i|")), F.startswith("key", F.lit("w|"))
    fits = F.col("said_kind").isNull() | F.col("kind").isNull() | (F.col("said_kind") == F.col("kind"))
    fits = fits & (F.col("letter").isNull() | F.arrays_overlap("words", "title_words"))
    rule = F.when(~is_number, ITEM_NUMBER).when(F.col("letter").isNull(), SPOKEN_NUMBER).otherwise(WRITTEN_NUMBER)
    named = F.min(F.when(~is_word & (~is_number | fits), F.struct(rule.alias("rule"), "said")))
    told = met.groupBy("meeting_id", "item_no", "line_id", "start_ms").agg(named.alias("x"), F.count_if(is_word).alias("n"), F.max("needed").alias("needed"))
    told = told.where((F.col("x").isNotNull()) | ((F.col("needed") > 0) & (F.col("n") == F.col("needed"))))
    read = told.join(line.select("meeting_id", "line_id", F.trim("text").alias("text")), ["meeting_id", "line_id"])
    direct = read.select("meeting_id", "item_no", "start_ms", F.coalesce("x", F.struct(F.lit(TITLE).alias("rule"), F.col("text").alias("said"))).alias("x")).select("meeting_id", "item_no", "start_ms", "x.*")
    # an announced title counts where no line of that moment names the item itself
    both = direct.withColumn("own", F.lit(True)).unionByName(_announced(item, line).withColumn("own", F.lit(False)))
    at = Window.partitionBy("meeting_id", "item_no", "start_ms")
    return both.withColumn("any", F.max("own").over(at)).where("own or not any").drop("own", "any")


def _announced(item: DataFrame, line: DataFrame) -> DataFrame:
    """Titles that a chair announces over several lines: from a cue on, up to the next one, within ANNOUNCED_MS. The item starts at the first line with one of its words."""
    order = Window.partitionBy("meeting_id").orderBy("start_ms", "line_id")
    so_far, is_cue = order.rowsBetween(Window.unboundedPreceding, 0), F.col("cue") > 0
    # lines are dealt to the cue they follow; a cue's own line also ends the stretch before it, up to the cue's place
    begun = F.last(F.when(is_cue, F.col("start_ms")), ignorenulls=True)
    cued = line.select("meeting_id", "line_id", "start_ms", "text", "cue").withColumns({"stretch": F.sum(is_cue.cast("int")).over(so_far), "from_ms": begun.over(so_far), "before_ms": begun.over(order.rowsBetween(Window.unboundedPreceding, -1))})
    piece = lambda stretch, text, since: F.struct(stretch.alias("stretch"), text.alias("piece"), since.alias("from_ms"))
    own = F.when(F.col("stretch") > 0, piece(F.col("stretch"), F.when(is_cue, F.expr("substr(text, cue)")).otherwise(F.col("text")), F.col("from_ms")))
    end = F.when(is_cue & (F.col("stretch") > 1), piece(F.col("stretch") - 1, F.expr("substr(text, 1, cue - 1)"), F.col("before_ms")))
    pieces = cued.select("meeting_id", "line_id", "start_ms", F.explode(F.array_compact(F.array(own, end))).alias("p")).select("meeting_id", "line_id", "start_ms", "p.*")
    near = pieces.where(F.col("start_ms") <= F.col("from_ms") + ANNOUNCED_MS).withColumn("piece", F.trim("piece"))
    whole = near.groupBy("meeting_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("start_ms", "line_id", "piece"))).alias("pieces"))  # lines of ANNOUNCED_MS
    heard = whole.withColumn("words", F.array_distinct(F.flatten(F.transform("pieces", lambda p: spoken_words(p["piece"])))))
    reading = item.select("meeting_id", "item_no", F.posexplode("readings").alias("reading", "ws"))
    wanted = reading.select("meeting_id", "item_no", "reading", "ws", F.explode("ws").alias("word"))
    met = wanted.join(heard.select("meeting_id", "stretch", F.explode("words").alias("word")), ["meeting_id", "word"]).groupBy("meeting_id", "stretch", "item_no", "reading", "ws").agg(F.count("*").alias("n")).where("n = size(ws)")
    chosen = met.groupBy("meeting_id", "stretch", "item_no").agg(F.min_by("ws", "reading").alias("ws"))
    out = chosen.join(whole, ["meeting_id", "stretch"]).withColumn("later", F.expr("slice(pieces, array_position(transform(pieces, p -> arrays_overlap(transform(regexp_extract_all(p.piece, \"[A-Za-z']+\", 0), w -> lower(w)), ws)), true), size(pieces))"))
    said = F.array_join(F.transform("later", lambda p: p["piece"]), " ")
    return out.groupBy("meeting_id", "item_no", F.col("later")[0]["start_ms"].alias("start_ms")).agg(F.lit(TITLE).alias("rule"), F.min(said).alias("said"))


def align(items: DataFrame, lines: DataFrame, videos: DataFrame) -> DataFrame:
    """[CX1] meeting_id, item_no, number, method (spoken, published or none), start_ms, end_ms, said, offset_s, reason.

    Spoken places are the longest chain in agenda order. Where three or more of them agree with published times on one
    offset, the other items get their published time less the offset, if that lies in the video, near a line that
    mentions the item, and not against a spoken place. An item ends where the next one starts.

    Features of items and lines, the places found and the times judged are each computed once, as tables in the shared folder; the
    result reads the last ones (see Cuts)."""
    cuts = Cuts(items.sparkSession, "alignment")
    item, line = _features(items, lines, cuts)
    found = cuts.write("found", candidates(item, line))
    chain = last_in_order(found.select(F.col("meeting_id").alias("group"), F.col("item_no").alias("item"), F.col("start_ms").alias("time")).distinct())
    spoken = chain.select(F.col("group").alias("meeting_id"), F.col("item").alias("item_no"), F.col("time").alias("start_ms"))
    evidence = found.join(spoken, ["meeting_id", "item_no", "start_ms"]).groupBy("meeting_id", "item_no", F.col("start_ms").alias("spoken_ms")).agg(F.min(F.struct("rule", "said")).alias("x")).select("meeting_id", "item_no", "spoken_ms", "x.said")
    placed = cuts.write("placed", item.select("meeting_id", "item_no", "number", "title_words", "seconds").join(evidence, ["meeting_id", "item_no"], "left"))
    cuts.drop("items", "found")

    anchors = placed.where("spoken_ms is not null and seconds is not null").select("meeting_id", (F.col("seconds") - F.col("spoken_ms") / 1000).alias("difference"))
    offsets = agreed_offset(anchors, "meeting_id", "difference", TOLERANCE_S, LEAST_ANCHORS).select("meeting_id", F.col("offset").alias("offset_s"))
    last = line.groupBy("meeting_id").agg(F.max_by("end_ms", F.struct("start_ms", "line_id")).alias("last_ms"))
    of_meeting = offsets.join(videos, "meeting_id", "full_outer").join(last, "meeting_id", "full_outer").withColumn("video_ms", F.coalesce("duration_ms", "last_ms", F.lit(0)))
    known = placed.join(of_meeting.select("meeting_id", "offset_s", "video_ms"), "meeting_id", "left").withColumn("video_ms", F.coalesce("video_ms", F.lit(0)))
    shifted = known.withColumn("shifted_ms", F.when(F.col("spoken_ms").isNull(), (F.col("seconds") - F.col("offset_s")) * 1000))
    agenda = Window.partitionBy("meeting_id").orderBy("item_no")
    earlier = F.last("spoken_ms", ignorenulls=True).over(agenda.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first("spoken_ms", ignorenulls=True).over(agenda.rowsBetween(1, Window.unboundedFollowing))
    judged = cuts.write("judged", shifted.withColumns({"earlier": earlier, "following": following}))
    cuts.drop("placed")

    outside = (F.col("seconds") < 0) | (F.col("seconds") * 1000 >= F.col("video_ms"))
    out_shifted = (F.col("shifted_ms") < 0) | (F.col("shifted_ms") >= F.col("video_ms"))
    against = F.coalesce(F.col("shifted_ms") < F.col("earlier"), F.lit(False)) | F.coalesce(F.col("shifted_ms") > F.col("following"), F.lit(False))
    told = judged.join(_mentioned(judged.where("shifted_ms is not null"), line), ["meeting_id", "item_no"], "left")
    reason = (
        F.when(F.col("spoken_ms").isNotNull(), None)
        .when(F.col("seconds").isNull(), "no published time")
        .when(outside, "published time outside the video")
        .when(F.col("offset_s").isNull(), "no agreed offset")
        .when(out_shifted, "shifted time outside the video")
        .when(F.col("mention").isNull(), "not mentioned near its time")
        .when(against, "against the spoken order")
    )
    told = told.withColumn("reason", reason)
    start = F.coalesce("spoken_ms", F.when(F.col("reason").isNull(), F.col("shifted_ms")))
    method = F.when(F.col("spoken_ms").isNotNull(), "spoken").when(start.isNotNull(), "published").otherwise("none")
    told = told.withColumns({"method": method, "start_ms": start.cast("long")})
    # items without a place stand apart, so that none of them ends another
    timed = with_ends(told.withColumn("_placed", F.struct("meeting_id", F.col("start_ms").isNull())), "_placed", "start_ms", F.col("video_ms"), ["item_no"])
    end = F.when(F.col("start_ms").isNotNull(), F.col("end").cast("long"))
    offset = F.when(F.col("method") == "published", F.col("offset_s"))
    return timed.select("meeting_id", "item_no", "number", "method", "start_ms", end.alias("end_ms"), F.coalesce("said", F.when(F.col("method") == "published", F.col("mention"))).alias("said"), offset.alias("offset_s"), "reason")


def _mentioned(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """meeting_id, item_no, mention: the title words that are said within MENTION_MS of the shifted time. Times meet in bins, not by a range join."""
    size = 2 * MENTION_MS
    low, high = F.col("shifted_ms") - MENTION_MS, F.col("shifted_ms") + MENTION_MS
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    asked = wanted.select("meeting_id", "item_no", low.alias("low"), high.alias("high"), F.explode("title_words").alias("word"))
    asked = asked.withColumn("bin", bins(F.col("low"), F.col("high")))
    near = lines.select("meeting_id", "start_ms", "end_ms", F.explode("words").alias("word"), bins(F.col("start_ms"), F.greatest("start_ms", "end_ms")).alias("bin"))
    met = asked.join(near, ["meeting_id", "word", "bin"]).where("end_ms >= low and start_ms <= high")
    return met.groupBy("meeting_id", "item_no").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("mention"))
