"""Numbers of ordinances, resolutions and agenda items in text, as arrays of structs by small Arrow-batched functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Fixed value: the forms of a record's number, in the order in which they are tried.
RECORD_NUMBER = re.compile(
    r"(?P<letter1>\b[OR])\s*-\s*(?P<year1>20\d{2})\s*-\s*(?P<number1>\d{1,3})\b"
    r"|(?P<letter2>\b[OR])\s*(?P<year2>20\d{2})(?P<number2>\d{2})\b"
    r"|\b(?P<year3>20\s\d{2})\s*-\s*(?P<number3>\d{1,3})\b"
    r"|\b(?P<year4>20\d{2})\s*-\s*(?P<number4>\d{1,3})\b"
    r"|\b(?P<year5>20\d{2})(?P<number5>\d{2})\b"
)
#: The two kinds with their letters; and how far before a number its kind is looked for.
KINDS = {"O": "ordinance", "R": "resolution"}
KIND_WORDS, KIND_SIGNS = 4, 80
#: Number words that name an item; the form of a reference; the signs around a word that don't count.
NUMBER_WORDS = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), range(1, 21)))
AFTER_ITEM = re.compile(r"\b(?:agenda\s+)?items?\s+(\S+(?:\s+\S+){0,2})", re.I)
PART = re.compile(r"(\d{1,2})([a-z])?|([a-z])(\d{1,2})?|([a-z]+)")
SIGNS = ".,;:!?\"'()[]"

IDENTIFIER = StructType().add("kind", StringType()).add("year", IntegerType()).add("number", IntegerType()).add("text", StringType()).add("start", IntegerType()).add("letter", StringType())
REFERENCE = StructType().add("parts", ArrayType(StringType())).add("text", StringType()).add("start", IntegerType())


def _identifiers(text: str) -> list[dict]:
    out = []
    for m in RECORD_NUMBER.finditer(text):
        got = {name[:-1]: value for name, value in m.groupdict().items() if value is not None}
        kind = KINDS.get(got.get("letter", ""))
        if kind is None:
            before = re.findall("[A-Za-z']+", text[max(0, m.start() - KIND_SIGNS) : m.start()])[-KIND_WORDS:]
            kind = next((k for w in reversed(before) for k in KINDS.values() if w.lower().startswith(k)), None)
        out.append({"kind": kind, "year": int(re.sub(r"\s", "", got["year"])), "number": int(got["number"]), "text": m[0], "start": m.start(), "letter": got.get("letter")})
    return out


def _parts(words: list[str]) -> list[str]:
    parts: list[str] = []
    for word in words:
        m = PART.fullmatch(word.lower().strip(SIGNS))
        if not m or (m[5] and m[5] not in NUMBER_WORDS):
            break
        parts += [str(NUMBER_WORDS[m[5]])] if m[5] else [p.upper() if p.isalpha() else str(int(p)) for p in m.groups()[:4] if p]
    return parts[:3]


def _references(text: str) -> list[dict]:
    return [{"parts": p, "text": m[0].strip(), "start": m.start()} for m in AFTER_ITEM.finditer(text) if (p := _parts(m[1].split()))]


@F.pandas_udf(ArrayType(IDENTIFIER))
def identifiers(texts: pd.Series) -> pd.Series:
    """[ST7] Record numbers: written (letter) or spoken; the kind is the letter's, or the nearest of the last words' before it, or null."""
    return texts.fillna("").map(_identifiers)


@F.pandas_udf(ArrayType(REFERENCE))
def item_references(texts: pd.Series) -> pd.Series:
    """[ST9] Item numbers after `item`, as up to three parts."""
    return texts.fillna("").map(_references)


def canonical(identifier: Column) -> Column:
    """[ST8] O-2026-54, R-2026-52, or 2026-56 where the kind isn't known."""
    letter = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (v, f"{k}-")])[identifier["kind"]]
    return F.concat(F.coalesce(letter, F.lit("")), identifier["year"].cast("string"), F.lit("-"), F.lpad(identifier["number"].cast("string"), F.greatest(F.lit(2), F.length(identifier["number"].cast("string"))), F.lit("0")))
