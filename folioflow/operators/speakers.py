"""Who speaks: runs of lines, the last naming in each run, and the official it names. lines: meeting_id, line_id, start_ms, text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from folioflow.functions.names import match_names
from folioflow.operators.temporal import runs

#: The mark of a new speaker; titles; the pro tem forms that captions write; thanks, fillers, and words of a motion's summary.
CHANGE = ">>"
TITLE = r"(?P<title>(?:the\s+)?(?:mayor\s+pro\s*tem|mayor|council\s*(?:member|woman|man)|councilor|commissioner|member))"
NAMED = re.compile(rf"\b{TITLE}\b[\s,]*(?P<name>(?:[A-Za-z'’-]+[\s]*){{0,3}})", re.I)
PRO_TEM = re.compile(r"^(?:pro\s*tem|protem|port|prom)\b\s*", re.I)
THANKS = {"thank", "thanks", "thankful", "appreciate"}
FILLERS = {"um", "uh", "the", "so", "and", "then", "okay"}
MOVED, SECONDED = {"made", "moved", "motion", "mover"}, {"seconded", "second", "seconder"}

NAMING = ArrayType(StructType().add("kind", StringType()).add("spoken", StringType()).add("role", StringType()).add("said", StringType()))


def _role(words: list[str]) -> str | None:
    near = [w for w in words if len(w) > 1 and w not in FILLERS]
    head = near[1] if len(near) > 1 and near[0] == "by" else near[0] if near and near[0] != "by" else ""
    return "mover" if head in MOVED - {"motion"} else "seconder" if head in SECONDED else None


def _namings(text: str) -> list[dict]:
    out = []
    cased = text != text.lower()
    for m in NAMED.finditer(text):
        before = re.findall("[a-z']+", text[: m.start()].lower())[::-1]
        if THANKS & set(before[:2]):
            continue
        words = [w.strip(".,;:!?\"'") for w in m["name"].split()]
        pro_tem = "pro" in m["title"].lower().split() or bool(PRO_TEM.match(m["name"].lstrip()))
        spoken = PRO_TEM.sub("", " ".join(filter(None, words)))
        first = spoken.split()[0] if spoken else ""
        if first and not first[0].isupper():
            if cased:  # an ordinary word after a title, not a name
                if not pro_tem:
                    continue
                spoken = ""
        else:  # a name ends at the first word that isn't written as one
            spoken = " ".join(w for k, w in enumerate(spoken.split()) if all(x[0].isupper() for x in spoken.split()[: k + 1]))
        kind = "mayor_pro_tem" if pro_tem else "mayor" if "mayor" in m["title"].lower() else "member"
        said = re.split(r"(?<=[.!?])\s+", text[: m.end()])[-1]
        out.append({"kind": kind, "spoken": spoken, "role": _role(before[:3]), "said": said})
    return out


@F.pandas_udf(NAMING)
def namings(texts: pd.Series) -> pd.Series:
    """[ST25] Titles with up to three words after them: kind of seat, name, role in a motion's summary (null: the floor is handed over). Thanks name nobody."""
    return texts.fillna("").map(_namings)


def speaker_runs(lines: DataFrame) -> DataFrame:
    """[WN5] meeting_id, run, start_ms, text: lines from one change of speaker to the next."""
    opens = F.ltrim("text").startswith(CHANGE)
    numbered = runs(lines, "meeting_id", ["start_ms", "line_id"], opens)
    listed = F.sort_array(F.collect_list(F.struct("start_ms", "line_id", "text")))
    whole = numbered.groupBy("meeting_id", "run").agg(listed.alias("xs"))
    return whole.select("meeting_id", "run", F.col("xs")[0]["start_ms"].alias("start_ms"), F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("text"))


def label_runs(lines: DataFrame, officials: DataFrame, holders: DataFrame) -> DataFrame:
    """[CX3, WN6] meeting_id, run, start_ms, kind, spoken, person_id, score, method: whom the last naming of the run before hands the floor to.

    A seat with one holder (holders: meeting_id, kind, person_id) is its holder's, if no name follows the title or the name
    after it sounds like the holder's; a plain member is read by sound (officials: meeting_id, person_id, name). No
    person_id where no reading holds; runs that nobody is handed are left out."""
    whole = speaker_runs(lines)
    handed = F.filter(namings("text"), lambda n: n["role"].isNull())
    order = Window.partitionBy("meeting_id").orderBy("run")
    last = whole.withColumn("naming", F.element_at(F.when(F.size(handed) > 0, handed), -1))
    labelled = last.withColumn("naming", F.lag("naming").over(order)).where("naming is not null").select("meeting_id", "run", "start_ms", "naming.kind", "naming.spoken")
    sound = match_names(labelled.where("spoken <> ''").select(F.col("meeting_id").alias("body_id"), F.col("run").alias("spoken_id"), "spoken"), officials.select(F.col("meeting_id").alias("body_id"), "person_id", "name"))
    heard = sound.select(F.col("body_id").alias("meeting_id"), F.col("spoken_id").alias("run"), F.col("person_id").alias("heard_id"), "score", "passed")
    x = labelled.join(heard, ["meeting_id", "run"], "left").join(holders.select("meeting_id", "kind", F.col("person_id").alias("holder_id")), ["meeting_id", "kind"], "left")
    passed = F.coalesce("passed", F.lit(False))
    seat = F.col("holder_id").isNotNull() & ((F.col("spoken") == "") | (passed & (F.col("heard_id") == F.col("holder_id"))))
    member = (F.col("kind") == "member") & passed
    person = F.when(F.col("kind") == "member", F.when(member, F.col("heard_id"))).when(seat, F.col("holder_id"))
    method = F.when(member, "sound").when((F.col("kind") != "member") & seat, "seat").otherwise("unidentified")
    score = F.when(method == "seat", 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return x.select("meeting_id", "run", "start_ms", "kind", "spoken", person.alias("person_id"), score.alias("score"), method.alias("method"))


def cross_check(lines: DataFrame, motions: DataFrame, officials: DataFrame) -> DataFrame:
    """[CX4, JN19] meeting_id, ordinal, role, spoken, agrees: for each printed motion with a time (motions: meeting_id, ordinal, start_ms,
    end_ms, mover, seconder), the movers and seconders that the runs within its time name, each name and role once."""
    whole = speaker_runs(lines).select("meeting_id", F.col("start_ms").alias("at"), F.explode(namings("text")).alias("n")).where("n.role is not null and n.spoken <> ''")
    near = motions.join(whole, "meeting_id").where((F.col("at") >= F.col("start_ms")) & (F.col("at") < F.col("end_ms")))
    said = near.select("meeting_id", "ordinal", F.col("n.role").alias("role"), F.col("n.spoken").alias("spoken"), F.when(F.col("n.role") == "mover", F.col("mover")).otherwise(F.col("seconder")).alias("printed")).dropDuplicates(["meeting_id", "ordinal", "role", "spoken"])
    keyed = said.withColumn("spoken_id", F.xxhash64("ordinal", "role", "spoken"))
    heard = match_names(keyed.select(F.col("meeting_id").alias("body_id"), "spoken_id", "spoken"), officials.select(F.col("meeting_id").alias("body_id"), "person_id", "name"))
    named = keyed.join(heard.select(F.col("body_id").alias("meeting_id"), "spoken_id", "person_id", "passed"), ["meeting_id", "spoken_id"]).join(officials.select("meeting_id", "person_id", "name"), ["meeting_id", "person_id"], "left")
    agrees = F.when(F.col("passed"), F.contains(F.lower("printed"), F.lower(F.element_at(F.split("name", " "), -1))))
    return named.select("meeting_id", "ordinal", "role", "spoken", agrees.alias("agrees"))


def seat_intervals(seats: DataFrame, observed: DataFrame) -> DataFrame:
    """[CX13] person_id, body_id, title, start_date, end_date: an open seat is used again, its start moves earlier and never later; a new title opens one.

    observed: person_id, body_id, title, on."""
    key = ["person_id", "body_id", "title"]
    seen = observed.groupBy(*key).agg(F.min("on").alias("seen"))
    opened, closed = seats.where("end_date is null"), seats.where("end_date is not null")
    both = opened.join(seen, key, "full_outer")
    start: Column = F.when(F.col("start_date").isNotNull() | F.col("seen").isNotNull(), F.least("start_date", "seen"))
    return both.select(*key, start.alias("start_date"), F.col("end_date")).unionByName(closed.select(*key, "start_date", "end_date"))
