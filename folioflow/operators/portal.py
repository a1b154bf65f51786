"""Listed titles and the bodies they name; consent motions and what they leave out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from folioflow.functions.references import NUMBER_WORDS
from folioflow.functions.text import first_needle, fold_name, number_key
from folioflow.functions.times import title_day

#: Words of a title that tell the sitting, its state, how it was held or gathered; separators, marks, months; last words that a title may leave off.
SITTINGS = ["continued meeting", "executive session", "joint meeting", "joint session", "pre session", "regular session", "special meeting", "special session", "study session", "work session", "workshop", "hearings", "meeting", "session"]
CANCELLED, CONTINUED = ["cancelled", "canceled"], ["postponed", "continued"]
HELD = ["in person", "livestreamed", "livestreaming", "livestream", "virtual", "remote"]
TYPES = ["executive", "special", "regular", "joint", "study", "work"]
GATHERINGS = ["annual", "retreat", "day 1", "day 2"]
SEPARATORS, MARKS, DASHES = [" - ", ": "], " .,-~*:;|/", "‐‑‒–—―−-"
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec".split()
LAST_WORDS = ["commission", "board", "committee", "authority"]
EXCEPTION = r"(?i)\b(?:with\s+the\s+exception\s+of|excepting|except|excluding|pulling|pulled|minus)\b"

_FOLD = str.maketrans({c: " " for c in DASHES})
_anywhere = lambda words: re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(words, key=len, reverse=True))})(?![^\W_])", re.I)
_SAID, _STATE, _HELD, _GATHER = (_anywhere(w) for w in (SITTINGS + CANCELLED + HELD, CONTINUED, HELD, GATHERINGS))
_TYPE = re.compile(rf"\s*(?:{'|'.join(TYPES)})(?![^\W_])", re.I)
_HUNG = [rf"[\s(]*\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\)?\s*$", rf"(?:\s+meeting)?\s+(?:{'|'.join(MONTHS + SHORT_MONTHS)})\.?\s+\d{{1,2}},?\s+\d{{4}}\s*$", rf"\s+(?:{'|'.join(MONTHS)})\s*$"]


def _blank(pattern: re.Pattern, text: str) -> str:
    """The text without the places where the pattern is found once dashes are read as blanks."""
    places, out, at = [m.span() for m in pattern.finditer(text.translate(_FOLD))], "", 0
    for a, b in places:
        out, at = out + text[at:a], b
    return out + text[at:]


def _tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(MARKS)


def _name_in(part: str) -> str:
    if m := _STATE.search(part.translate(_FOLD)):
        part = part[: m.start()].rstrip(MARKS)
    if m := _TYPE.match(part.translate(_FOLD)):
        part = part[m.end() :]
    name = _tidy(_blank(_SAID, part))
    for pattern in _HUNG:
        name = re.sub(pattern, "", name, flags=re.I)
    if (m := re.search(r"\s*\(([A-Z]{2,8})\)\s*$", name)) and m[1].lower() == "".join(w[0] for w in name[: m.start()].split() if w[0].isalpha()).lower():
        name = name[: m.start()]
    return _tidy(re.sub(r"\s*\(\s*\)\s*", " ", name))


def _body_name(title: str) -> str:
    text = title.strip()
    by = next((s for s in SEPARATORS if s in text), None)
    parts = [p.strip() for p in text.split(by, 1)] if by else [text]
    names = [_name_in(p) for p in parts]
    if not names[0] and _HELD.search(parts[0].translate(_FOLD)):
        return _tidy(parts[0])
    return next(filter(None, names), _tidy(parts[0]))


def _gathered(title: str) -> list[str]:
    """The sides of a title whose other sides are all gatherings."""
    sides = [s.strip() for s in re.split("|".join(map(re.escape, SEPARATORS)), title) if s.strip()]
    empty = [not _blank(_GATHER, s).strip(MARKS + "()") for s in sides]
    return [s for k, s in enumerate(sides) if len(sides) > 1 and all(e for j, e in enumerate(empty) if j != k)]


@F.pandas_udf(StringType())
def body_name(titles: pd.Series) -> pd.Series:
    """[ST16] The body that a listed title names: without sitting, state, type, dates and a repeated acronym."""
    return titles.fillna("").map(_body_name)


@F.pandas_udf(ArrayType(StringType()))
def gathered_sides(titles: pd.Series) -> pd.Series:
    return titles.fillna("").map(_gathered)


def resolve_bodies(titles: DataFrame, bodies: DataFrame) -> DataFrame:
    """[JN15] title_id, name, body_id: the body of the same area that a title names. titles: title_id, area_id, city, own_body_id, title;
    bodies: area_id, body_id, name.

    First by folded name (of several, the smallest id); then a side of the title beside a gathering; then, if one body only
    fits, without the city's name in front or the body's last word. A title without any name has the source's own body.
    Each step is an equi join on area and folded name."""
    named = titles.withColumn("name", body_name("title")).withColumn("folded", fold_name(F.col("name")))
    known = bodies.select("area_id", "body_id", fold_name(F.col("name")).alias("key"))
    least = known.groupBy("area_id", "key").agg(F.min("body_id").alias("body_id"))

    exact = named.join(least.withColumnRenamed("key", "folded"), ["area_id", "folded"]).select("title_id", F.lit(1).alias("step"), "body_id")
    sides = named.where("name <> ''").select("title_id", "area_id", F.posexplode(gathered_sides("title")).alias("place", "side")).withColumn("key", fold_name(F.col("side")))
    gathered = sides.join(least, ["area_id", "key"]).groupBy("title_id").agg(F.min_by("body_id", "place").alias("body_id")).select("title_id", F.lit(2).alias("step"), "body_id")

    city = F.concat(fold_name(F.col("city")), F.lit(" "))
    led = F.when((F.length(city) > 1) & F.startswith(F.col("folded"), city), F.substr(F.col("folded"), F.length(city) + 1))
    asked = named.where("name <> ''").select("title_id", "area_id", F.explode(F.array_compact(F.array("folded", led))).alias("key"))
    last = F.regexp_extract("key", r" ([^ ]+)$", 1)
    short = F.when(last.isin(LAST_WORDS), F.regexp_extract("key", r"^(.*) [^ ]+$", 1))
    ways = known.select("area_id", "body_id", F.explode(F.array_compact(F.array("key", short))).alias("key"))
    fits = asked.join(ways, ["area_id", "key"]).groupBy("title_id").agg(F.count_distinct("body_id").alias("n"), F.min("body_id").alias("body_id")).where("n = 1").select("title_id", F.lit(3).alias("step"), "body_id")

    own = named.where("name = '' and own_body_id is not null").select("title_id", F.lit(4).alias("step"), F.col("own_body_id").alias("body_id"))
    best = exact.unionByName(gathered).unionByName(fits).unionByName(own).groupBy("title_id").agg(F.min_by("body_id", "step").alias("body_id"))
    return named.select("title_id", "name").join(best, "title_id", "left")


EXCEPTED = StructType().add("readable", BooleanType()).add("keys", ArrayType(StringType()))


def _excepted(clause: str | None, section: str) -> dict:
    if clause is None:
        return {"readable": True, "keys": []}
    keys: list[str] = []
    number = None  # the number read last, to which a letter may belong
    plain = lambda t: re.sub("[^A-Za-z0-9]", "", t).lower()
    for word in filter(None, (w.strip(" .:;,") for w in re.split(r"[,;&]|\band\b|\s+", clause, flags=re.I))):
        if len(word) == 1 and word.isalpha():
            if number is not None:
                keys.remove(plain(number))
            keys.append(plain(f"{section.rstrip('.') if number is None else number}{word}"))
            number = None
        elif word.lower() in NUMBER_WORDS or re.fullmatch(r"\d+(?:[A-Za-z]|\.[A-Za-z0-9]+)*", word):
            number = str(NUMBER_WORDS.get(word.lower(), word))
            keys.append(plain(number))
        else:
            number = None
    return {"readable": bool(keys), "keys": sorted(set(keys))}


@F.pandas_udf(EXCEPTED)
def _excepted_items(clauses: pd.Series, sections: pd.Series) -> pd.DataFrame:
    """[ST12] Item keys that an exception clause (null: none) names; a clause that names nothing readable is told apart from none."""
    return pd.DataFrame([_excepted(c, s) for c, s in zip(clauses, sections)], columns=["readable", "keys"])


excepted_items = _excepted_items.asNondeterministic()  # so that a filter on it doesn't run it a second time


def exception_clause(text: Column) -> Column:
    """What stands after the first word of exception; null if there is none."""
    at = F.regexp_instr(text, F.lit(EXCEPTION))
    return F.when(at > 0, F.regexp_replace(F.substr(text, at), f"^{EXCEPTION}", ""))


def consent_coverage(motions: DataFrame, items: DataFrame) -> DataFrame:
    """[ST12, JN18] meeting_id, ordinal, item_no, covered for motions on the consent agenda: the section's items, less those taken out.

    A motion whose exceptions can't be read covers nothing and gives no row. motions: meeting_id, ordinal, text. Items and sections are merged
    with motions by meeting: Spark takes exploded rows for as few as those they come from, and would broadcast them."""
    section = items.where(F.lower(F.trim("title")).startswith("consent agenda")).groupBy("meeting_id").agg(F.min_by("number", "item_no").alias("section"))
    asked = motions.where(F.col("text").rlike(r"(?i)\bconsent\s+agenda\b")).join(section.hint("merge"), "meeting_id")
    read = asked.withColumn("x", excepted_items(exception_clause(F.col("text")), F.col("section"))).where("x.readable")
    base, own = F.regexp_replace("section", r"\.+$", ""), F.regexp_replace("number", r"\.+$", "")
    rest = F.substr(own, F.length(base) + 1)
    under = F.startswith(own, base) & rest.rlike(r"^(?:\..*|[A-Za-z])$")
    inside = read.join(items.select("meeting_id", "item_no", "number").hint("merge"), "meeting_id").where(under)
    return inside.select("meeting_id", "ordinal", "item_no", (~F.array_contains("x.keys", number_key(F.col("number")))).alias("covered"))

#: Words of a title that tell the kind of sitting, in the order in which they count; of a notice that cancels one; days beside a published one.
SITTING_KINDS = {
    "executive": "executive", "study": "study", "work session": "study", "workshop": "study", "pre session": "special",
    "special": "special", "joint meeting": "special", "joint session": "special", "regular": "regular",
}
NOTICE, NEARBY_DAYS = "notice of cancellation", 1


def _read(title: Column) -> Column:
    return F.translate(F.coalesce(title, F.lit("")), DASHES, " " * len(DASHES))


def meeting_type(title: Column) -> Column:
    """[ST17] The kind of sitting that a title names; a title that names none is a regular session."""
    return first_needle(_read(title), SITTING_KINDS, "regular")


def names_type(title: Column) -> Column:
    """Whether a title says its kind of sitting."""
    return first_needle(_read(title), SITTING_KINDS).isNotNull()


def cancelled_by(title: Column, templates: Column) -> Column:
    """[ST18] Why a listing is cancelled: its title's word, else the first of its documents (names of templates) that is a notice; else null."""
    word = F.nullif(F.regexp_extract(F.lower(title), rf"\b({'|'.join(CANCELLED)})\b", 1), F.lit(""))
    notice = F.filter(templates, lambda t: F.lower(t).contains(NOTICE))
    return F.coalesce(F.concat(F.lit("the title says "), word), F.when(F.size(notice) > 0, F.concat(F.lit("a document is a "), F.get(notice, F.lit(0)))))


def continued_by(title: Column) -> Column:
    """[ST18] Why a listing counts as continued: postponed and continued as whole words; else null."""
    return F.concat(F.lit("the title says "), F.nullif(F.regexp_extract(F.lower(title), rf"\b({'|'.join(CONTINUED)})\b", 1), F.lit("")))


def link_videos(videos: DataFrame, meetings: DataFrame) -> DataFrame:
    """[JN16] video_id, meeting_id, reason (linked, no body, no day, none or several): the one meeting of the body that a video recorded.

    The day is the one that the title names, else the published one. Meetings of that day come first; only if none fits, those of the days
    beside it count too. A meeting fits if both titles name one kind of sitting; where a title that names none meets no regular session, every
    meeting of the body in that time could be it. Two that could be it give none. Days are spread to keys: an equi join on body and day.

    videos: video_id, body_id (null: not known), title, published; meetings: meeting_id, body_id, starts_at (ISO text: its day counts), title."""
    day = F.coalesce(title_day(F.col("title")), F.try_to_date(F.substring(F.regexp_replace(F.trim("published"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), 1, 10), "yyyy-MM-dd"))
    own = videos.select("video_id", "body_id", day.alias("own_day"), meeting_type(F.col("title")).alias("wanted"), names_type(F.col("title")).alias("strict"))
    held = meetings.select("meeting_id", "body_id", F.try_to_date(F.substring("starts_at", 1, 10), "yyyy-MM-dd").alias("day"), meeting_type(F.col("title")).alias("kind"))
    spread = own.where("body_id is not null and own_day is not null").withColumn("day", F.explode(F.sequence(F.date_sub("own_day", NEARBY_DAYS), F.date_add("own_day", NEARBY_DAYS))))
    met = spread.join(held, ["body_id", "day"])
    same, like = F.col("day") == F.col("own_day"), F.col("kind") == F.col("wanted")
    n = lambda test: F.count_if(test)
    least = lambda test: F.min(F.when(test, F.col("meeting_id")))
    per = met.groupBy("video_id").agg(
        n(same & like).alias("n1"), least(same & like).alias("m1"), n(same & ~F.col("strict")).alias("n2"), least(same & ~F.col("strict")).alias("m2"),
        n(like).alias("n3"), least(like).alias("m3"), n(~F.col("strict")).alias("n4"), least(~F.col("strict")).alias("m4"),
    )
    # on the day: those alike, else (for a title without a kind) all; if that is nobody, the same over the days around
    count = F.when(F.col("n1") > 0, F.col("n1")).when(F.col("n2") > 0, F.col("n2")).when(F.col("n3") > 0, F.col("n3")).otherwise(F.col("n4"))
    chosen = F.when(F.col("n1") > 0, F.col("m1")).when(F.col("n2") > 0, F.col("m2")).when(F.col("n3") > 0, F.col("m3")).otherwise(F.col("m4"))
    told = own.join(per, "video_id", "left").withColumn("n", F.coalesce(count, F.lit(0)))
    reason = F.when(F.col("body_id").isNull(), "no body").when(F.col("own_day").isNull(), "no day").when(F.col("n") == 1, "linked").when(F.col("n") == 0, "none").otherwise("several")
    return told.select("video_id", F.when(F.col("n") == 1, chosen).alias("meeting_id"), reason.alias("reason"))

#: What titles of meetings carry in any area, and titles that carry it but are none.
KEYWORDS = ["City Council", "Planning and Zoning", "Advisory Board", "Commission", "Authority", "Study Session", "Regular Session"]
SKIP_TITLES = ["This Week in Council", "Neighborhood Meeting", "Esports"]


def classified(titles: DataFrame, sources: DataFrame) -> DataFrame:
    """[FLT6, UD6] title_id, is_meeting, keywords, skips, problem: which titles are meetings', by the lists of their own source.

    A source's settings are JSON with meeting_keywords and meeting_skip_titles; a list it doesn't hold is the built-in one, and so are both where the
    settings are no JSON object, which problem tells. Phrases match as whole words without case; a skip phrase outweighs keywords.
    titles: title_id, source_id, title; sources: source_id, settings."""
    text = F.trim(F.coalesce("settings", F.lit("")))
    read = F.from_json(text, "meeting_keywords array<string>, meeting_skip_titles array<string>")
    is_json = F.get_json_object(text, "$").isNotNull()
    problem = F.when(text == "", None).when(~is_json, "the settings are not JSON").when(~F.startswith(text, F.lit("{")), "the settings are not an object")
    # a phrase is compared as text: its signs are quoted, and the ends stand beside a sign of another kind than theirs
    quoted = lambda phrases: F.transform(F.filter(phrases, lambda p: p.isNotNull() & (p != "")), lambda p: F.struct(p.alias("phrase"), F.concat(F.lit(r"(?iU)\b\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")).alias("pattern")))
    seeds = lambda words: F.array(*map(F.lit, words))
    own = lambda c, words: F.coalesce(F.when(problem.isNull(), F.col("read")[c]), seeds(words))
    lists = sources.withColumn("read", read).select("source_id", problem.alias("problem"), quoted(own("meeting_keywords", KEYWORDS)).alias("k"), quoted(own("meeting_skip_titles", SKIP_TITLES)).alias("s"))
    asked = titles.join(lists, "source_id", "left").withColumns({"k": F.coalesce("k", quoted(seeds(KEYWORDS))), "s": F.coalesce("s", quoted(seeds(SKIP_TITLES)))})
    title = F.coalesce("title", F.lit(""))
    found = lambda c: F.transform(F.filter(c, lambda p: F.regexp_like(title, p["pattern"])), lambda p: p["phrase"])
    out = asked.select("title_id", "problem", found("k").alias("keywords"), found("s").alias("skips"))
    return out.select("title_id", ((F.size("keywords") > 0) & (F.size("skips") == 0)).alias("is_meeting"), "keywords", "skips", "problem")
