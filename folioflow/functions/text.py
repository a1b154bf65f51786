
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotation marks and the plain marks they become [ST2].
CURLED = "‘’‚‛“”„‟"
STRAIGHT = "''''\"\"\"\""
#: Named entities that caption files use [ST3].
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def collapse_space(text: Column) -> Column:
    """[ST1] Runs of white space, no-break spaces too, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def straighten(text: Column) -> Column:
    """[ST2] Curled quotation marks as straight ones, white space collapsed."""
    return collapse_space(F.translate(text, CURLED, STRAIGHT))


def strip_markup(text: Column) -> Column:
    """[ST3] Without tags, named entities decoded, the ampersand last, then numeric references (decimal and hexadecimal)."""
    named = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), F.regexp_replace(text, "<[^>]*>", ""))
    return F.when(named.rlike(NUMERIC), _numeric(named)).otherwise(named)


NUMERIC = "&#(?:[0-9]+|[xX][0-9a-fA-F]+);"


def _numeric(text: Column) -> Column:
    """Each numeric reference as its character: the text is cut at the references, and each one's code point is put between."""
    marks = F.regexp_extract_all(text, F.lit(f"({NUMERIC})"), F.lit(1))
    code = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.substr(m, F.lit(4), F.length(m) - 4), 16, 10)).otherwise(F.substr(m, F.lit(3), F.length(m) - 3)).cast("int")
    sign = lambda m: F.decode(F.unhex(F.lpad(F.hex(code(m)), 8, "0")), "UTF-32")
    return F.array_join(F.flatten(F.zip_with(F.split(text, NUMERIC, -1), marks, lambda t, m: F.array(t, F.coalesce(sign(m), F.lit(""))))), "")


def escape_markup(text: Column) -> Column:
    """[ST4]"""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def spoken_words(text: Column) -> Column:
    """[ST5] Runs of ASCII letters and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0)), F.lower)


def significant_words(text: Column, longer_than: int = 4) -> Column:
    """[ST6, SO6] Distinct spoken words of more letters than that, in the order of their first places."""
    return F.array_distinct(F.filter(spoken_words(text), lambda w: F.length(w) > longer_than))


def search_terms(text: Column) -> Column:
    """[FT1, FT4] Runs of letters and digits in lower case; the underscore parts words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fold_name(text: Column) -> Column:
    """[ST15] For comparing names of bodies: lower case, & read as and, all else but letters and digits one blank."""
    spelled = F.replace(F.lower(text), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def number_parts(number: Column) -> Column:
    """[ST10] Parts of an agenda number: 10.a.01 gives 10, A, 1."""
    parts = F.filter(F.split(F.trim(number), r"[.\s]+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), p.cast("long").cast("string")).otherwise(F.upper(p)))


def number_key(number: Column) -> Column:
    """[ST10] Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(number, "[^A-Za-z0-9]", ""))


def is_under(number: Column, section: Column) -> Column:
    """[ST11] Whether an item belongs to a section: its parts begin with the section's and go on."""
    own, head = number_parts(number), number_parts(section)
    return (F.size(own) > F.size(head)) & (F.slice(own, F.lit(1), F.size(head)) == head)


def footer_numbers(text: Column) -> Column:
    """[ST21] Numbers of the lines that are only `Page N`."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^Page\s+(\d+)\s*$"), F.lit(1)), lambda n: n.cast("int"))


def has_word(text: Column, word: Column) -> Column:
    """[ST28] Whole-word containment, without case."""
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), F.lower(word), F.lit("(?![a-z0-9])")))


def matched_phrases(title: Column, phrases: list[str]) -> Column:
    """[FLT6] Phrases that stand in the title as whole words, in the list's order."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.regexp_like(title, F.concat(F.lit(r"(?i)\b"), p, F.lit(r"\b"))))


def first_needle(text: Column, needles: dict[str, str], default: str | None = None) -> Column:
    """[ST17] The value of the first needle found in the text, by the dict's order."""
    found = F.lit(default)
    for needle, value in reversed(needles.items()):
        found = F.when(F.lower(text).contains(needle), value).otherwise(found)
    return found


def join_lines(lines: Column) -> Column:
    """[AG15] Lines as one text; one that ends with a hyphen, and an ordinal ending after a digit, join with no blank."""

    def add(whole: Column, line: Column) -> Column:
        tight = whole.endswith("-") | (whole.rlike("[0-9]$") & line.rlike("^(?:st|nd|rd|th)\\b"))
        return F.when(whole == "", line).when(tight, F.concat(whole, line)).otherwise(F.concat(whole, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), lambda a, x: add(a, F.trim(x)))


def version_key(text: Column) -> Column:
    """[ST33] The numbers that a version begins with, for comparing as arrays; null where it begins with none."""
    head = F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(head != "", F.transform(F.split(head, r"\."), lambda p: p.cast("long")))


def is_newer(candidate: Column, current: Column) -> Column:
    """[ST33] A later version; texts without numbers are newer if they differ."""
    a, b = version_key(candidate), version_key(current)
    return F.when(a.isNotNull() & b.isNotNull(), a > b).otherwise(F.trim(candidate) != F.trim(current))


def redact(text: Column, secrets: list[str]) -> Column:
    """[ST32]"""
    longest_first = sorted(filter(None, secrets), key=len, reverse=True)
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("***")), longest_first, text)


#: Hosts of videos, the path kinds that an id follows, and the form of an id [ST19].
VIDEO_HOSTS = r"^(?:[^/]*\.)?(?:youtube\.com|youtu\.be|youtube-nocookie\.com)$"
VIDEO_PATHS = "embed|live|shorts|v"
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"


def video_id(url: Column) -> Column:
    """[ST19] The id in a video's address: host from the list, then v=, the short host's path or a path kind; else null."""
    whole = F.when(url.contains("//"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    part = lambda pattern: F.regexp_extract(whole, pattern, 1)
    host = F.lower(part(r"^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)"))
    path = part(r"^[a-zA-Z]+://[^/?#]+/([^?#]*)")
    asked = part(r"[?&]v=([^&#]*)")
    by_kind = F.regexp_extract(path, rf"^/*(?i:{VIDEO_PATHS})/+([^/]+)", 1)
    found = F.when(host.rlike(r"(?:^|\.)youtu\.be$"), F.regexp_extract(path, "^/*([^/]*)", 1)).when(asked != "", asked).otherwise(by_kind)
    return F.when(host.rlike(VIDEO_HOSTS) & found.rlike(VIDEO_ID), found)


def channel_of(origin: Column) -> Column:
    """[ST20] struct<kind, value>: which form names a channel (id, handle, user or url)."""
    path = F.coalesce(F.nullif(F.regexp_extract(origin, r"^(?:https?://)?(?:[\w-]+\.)*youtube\.com/([^?#]*)", 1), F.lit("")), F.trim(origin))
    cid = F.regexp_extract(path, r"(?:^|channel/)(UC[A-Za-z0-9_-]{22})(?:/|$)", 1)
    handle = F.regexp_extract(path, r"^@([A-Za-z0-9._-]+)", 1)
    user = F.regexp_extract(path, r"^user/([^/]+)", 1)
    form = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    return F.when(cid != "", form("id", cid)).when(handle != "", form("handle", handle)).when(user != "", form("user", user)).otherwise(form("url", F.trim(origin)))
