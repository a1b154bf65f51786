"""Agendas as tables: HTML agendas with published times, and the text pages of printed ones."""

from __future__ import annotations

import functools
import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: Byte-order marks and their encodings; tags that hold nothing; the classes and attributes of an agenda's parts.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SECTION, TIME = "data-sectionid", "data-videolocation"
SECTION_NUMBER, SECTION_TITLE = "number-cell-section", "section-heading"
ITEM, ITEM_NUMBER, ITEM_TITLE = "meeting-item", "number-cell", "agenda-item"
PARAGRAPH, ATTACHED = "paragraph-break", "item_contents"

_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def encoding_of(data: bytes, content_type: str | None = None) -> str:
    """[SRC9] By a byte-order mark, the content type, a meta tag, else UTF-8 if the bytes are, else cp1252."""
    for mark, name in MARKS.items():
        if data.startswith(mark):
            return name
    declared = _CHARSET.search(content_type or "") or next((m for t in re.findall(rb"<meta[^>]*>", data, re.I) if (m := _CHARSET.search(t.decode("latin-1")))), None)
    if declared:
        return declared[1].lower()
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def decoded(data: bytes, content_type: str | None = None) -> str:
    """[SRC9] Text of a page; bytes that don't fit are replaced, an unknown encoding is read as UTF-8."""
    try:
        return data.decode(encoding_of(data, content_type), "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


@F.arrow_udf(StringType())
def decode_page(data: pa.Array, content_type: pa.Array) -> pa.Array:
    return _decoded_pages(data, content_type)


#: Pages whose texts stand in memory as Python's strings at once.
HELD = 64


def _decoded_pages(data: pa.Array, content_type: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    for at in range(0, len(data), HELD):
        pages = zip(data.slice(at, HELD), content_type.slice(at, HELD))
        parts.append(pa.array([decoded(d.as_py(), t.as_py()) if d.is_valid else None for d, t in pages], pa.string()))
    return pa.concat_arrays(parts)


class _Agenda(HTMLParser):
    """Walks the tags once. Each open tag knows which field its text goes to; an end tag closes all that are open inside its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.rows: list[dict] = []
        self.section: dict | None = None
        self.now: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        kinds = set(own.get("class", "").split())
        if tag in VOID:
            if tag == "br" and PARAGRAPH in kinds and self.open and self.open[-1][1] == "title" and self.now is not None:
                self.now["stopped"] = True
            return
        role = None if ATTACHED in kinds else self.open[-1][1] if self.open else None
        seconds = own.get(TIME, "").strip()
        if SECTION in own:
            self.section = self.now = {"number": "", "title": "", "seconds": int(seconds) if seconds.isdigit() else None, "section": None, "level": len(self.open)}
            self.rows.append(self.now)
            role = None
        elif ITEM in kinds and self.section is not None:
            self.now = {"number": "", "title": "", "seconds": int(seconds) if seconds.isdigit() else None, "section": self.section, "level": len(self.open)}
            self.rows.append(self.now)
            role = None
        elif self.now is not None:
            inside = self.now["section"] is not None
            number, title = (ITEM_NUMBER, ITEM_TITLE) if inside else (SECTION_NUMBER, SECTION_TITLE)
            for kind, field in ((number, "number"), (title, "title")):
                if kind in kinds and (tag == "td" or (inside and field == "title")) and not self.now.get(f"had_{field}"):
                    role, self.now[f"had_{field}"] = field, True
        self.open.append((tag, role))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            while self.now is not None and self.now["level"] >= len(self.open):
                self.now = self.now["section"]

    def handle_data(self, data: str) -> None:
        role = self.open[-1][1] if self.open else None
        if role and self.now is not None and not (role == "title" and self.now.get("stopped")):
            self.now[role] += data


#: A tag and the text after it; attributes in plain form (lower case, values in double quotes, without references); elements whose text is read raw.
_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)([^<>]*)>([^<]*)")
_ATTRIBUTE = re.compile(r'[ \t\r\n]+([a-z][a-z0-9_-]*)="([^"<>&]*)"')
_ATTRIBUTES = re.compile(rf"(?:{_ATTRIBUTE.pattern.replace('(', '(?:')})*[ \t\r\n]*")
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


@functools.lru_cache(1 << 12)
def _plain(end: str, tag: str, attributes: str) -> list[tuple[str, str]] | None:
    """A tag's attributes; None if the tag isn't plain."""
    if tag in _RAW or not _ATTRIBUTES.fullmatch(attributes) or (end and attributes.strip()):
        return None
    return _ATTRIBUTE.findall(attributes)


def _walked(html: str) -> _Agenda:
    """The page's tags and texts, walked. Where all tags are plain one pattern finds them, else the parser."""
    walk = _Agenda()
    found = _TAG.findall(html)
    plain = [_plain(*t[:3]) for t in found] if len(found) == html.count("<") else [None]
    if None in plain:
        walk.feed(html)
        walk.close()
        return walk
    for (end, tag, _, text), attributes in zip(found, plain):
        if end:
            walk.handle_endtag(tag)
        else:
            walk.handle_starttag(tag, attributes)
        if text:
            walk.handle_data(unescape(text) if "&" in text else text)
    return walk


def agenda_items(html: str) -> list[dict]:
    """[SRC8] number, title, seconds of the sections and items of an HTML agenda, in order. An item's number stands after its section's."""
    walk = _walked(html)
    plain = lambda t: " ".join(t.replace("\xa0", " ").split())
    stem = lambda t: plain(t).rstrip(".").strip()
    out = []
    for row in walk.rows:
        if number := stem(row["number"]):
            head = stem(row["section"]["number"]) if row["section"] else ""
            own = f"{number}." if row["section"] is None else f"{head}.{number}" if head else number
            out.append({"number": own, "title": plain(row["title"]), "seconds": row["seconds"]})
    return out


ITEMS = ArrayType(StructType().add("number", StringType()).add("title", StringType()).add("seconds", LongType()))


@F.arrow_udf(ITEMS)
def _items(pages: pa.Array) -> pa.Array:
    starts, rows = [0], []
    for page in pages:
        rows += agenda_items(page.as_py() or "")
        starts.append(len(rows))
    types = {"number": pa.string(), "title": pa.string(), "seconds": pa.int64()}
    parts = pa.StructArray.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), parts)


def html_agendas(pages: DataFrame, key: str, html: str, video_seconds: Column | None = None) -> DataFrame:
    """[SRC8] key, item_no (from 0), number, title, seconds, time_status (missing, outside_video or usable) of pages (key, html)."""
    length = F.lit(None).cast("long") if video_seconds is None else video_seconds
    rows = pages.select(key, length.alias("_length"), F.posexplode(_items(html)).alias("item_no", "i"))
    status = F.when(F.col("i.seconds").isNull(), "missing").when(F.col("i.seconds") > F.col("_length"), "outside_video").otherwise("usable")
    return rows.select(key, "item_no", "i.number", "i.title", "i.seconds", status.alias("time_status"))


#: The marks of printed items, each on a line of its own; page footers; the appendix; endings of ordinals set apart.
NUMBER_MARK, LETTER_MARK, SUB_MARK = r"^(\d{1,3})\.$", r"^([A-Za-z])\.$", r"^([A-Za-z])\.(\d{1,2})\.$"
PAGE_FOOT, APPENDIX, ORDINAL = r"(?i)^Page\s+\d+$", r"(?i)^Appendix\b", "^(?:st|nd|rd|th)$"


def _capitals(line: Column) -> Column:
    return line.rlike(r"\p{L}") & (line == F.upper(line))


def _title(lines: Column) -> Column:
    """Lines as one title: a short piece of capitals and an ordinal's ending join tight, a comma goes back to the word before it."""

    def add(title: Column, line: Column) -> Column:
        broken = _capitals(line) & line.rlike(r"^\p{L}{1,4}$")
        tight = broken | (title.rlike(r"\d$") & line.rlike(ORDINAL))
        return F.when(title == "", line).when(tight, F.concat(title, line)).otherwise(F.concat(title, F.lit(" "), line))

    return F.trim(F.regexp_replace(F.aggregate(lines, F.lit(""), add), r"\s+,", ","))


def printed_agendas(pages: DataFrame, key: str) -> DataFrame:
    """[SRC11] key, item_no (from 0), number, title of the text pages (key, page, text) of printed agendas.

    Footers go with the line above them. A number opens a section, whose title is the next line and capital lines after it; a letter, or
    letter and number, in a section opens an item, whose title goes on to the next mark or blank line. After the appendix numbers
    stand alone. Marks are found by running counts over a document's lines, so none is walked by hand."""
    split = pages.select(key, "page", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("line_no", "raw"))
    clean = split.withColumn("line", F.trim(F.regexp_replace("raw", r"[\s ]+", " "))).drop("raw")
    page = Window.partitionBy(key, "page")
    last = F.max(F.when(F.col("line") != "", F.struct("line_no", "line"))).over(page)
    foot = F.coalesce(last["line"].rlike(PAGE_FOOT), F.lit(False))
    body = clean.withColumns({"last": last["line_no"], "foot": foot}).where("line_no <= last and not (foot and line_no >= last - 1)")
    order = Window.partitionBy(key).orderBy("page", "line_no")
    t = F.col("line")
    kind = F.when(t.rlike(APPENDIX), "appendix").when(t.rlike(NUMBER_MARK), "number").when(t.rlike(LETTER_MARK), "letter").when(t.rlike(SUB_MARK), "sub").when(t == "", "blank").otherwise("text")
    marked = body.withColumn("kind", kind).withColumn("after", F.max((F.col("kind") == "appendix").cast("int")).over(order) == 1)
    section = F.last(F.when((F.col("kind") == "number") & ~F.col("after"), F.regexp_extract(t, NUMBER_MARK, 1)), ignorenulls=True).over(order)
    marked = marked.withColumns({"section": F.when(~F.col("after"), section), "part": F.sum((F.col("kind") != "text").cast("int")).over(order)})
    number = (
        F.when((F.col("kind") == "number") & F.col("after"), F.regexp_extract(t, NUMBER_MARK, 1))
        .when(F.col("kind") == "number", F.concat(F.col("section"), F.lit(".")))
        .when(F.col("kind") == "letter", F.concat(F.col("section"), F.lit("."), F.regexp_extract(t, LETTER_MARK, 1)))
        .when(F.col("kind") == "sub", F.concat(F.col("section"), F.lit("."), F.regexp_replace(t, SUB_MARK, "$1.$2")))
    )
    rows = marked.withColumn("number", number)
    head = lambda c: F.max(F.when(F.col("kind") != "text", F.col(c)))
    text = F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("page", "line_no", "line"))))
    parts = rows.groupBy(key, "part").agg(head("number").alias("number"), head("kind").alias("kind"), head("after").alias("after"), text.alias("xs")).where("number is not null and size(xs) > 0")
    lines = F.transform("xs", lambda x: x["line"])
    # of a section's title: the first line, and if it is in capitals those after it up to the first that isn't
    capitals = F.transform(lines, _capitals)
    until = F.array_position(capitals, False)
    kept = F.when(F.element_at(capitals, 1) & (until == 0), lines).otherwise(F.slice(lines, F.lit(1), F.greatest(F.lit(1), until.cast("int") - 1)))
    title = _title(F.when((F.col("kind") == "number") & ~F.col("after"), kept).otherwise(lines))
    place = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return parts.withColumn("title", title).where("title <> ''").select(key, place.alias("item_no"), "number", "title")
