"""Names by sound: phonetic keys as a column expression, Jaro-Winkler as an Arrow-batched function, and the join of both."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The public Soundex classes; vowels, h, w and y have none.
SOUND_CLASSES = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
SILENT = "aeiouhwy"
#: A reading holds from this score, and with this lead over the second best.
LEAST_SCORE, LEAST_LEAD = 0.72, 0.05

_LETTERS = "".join(SOUND_CLASSES.values())
_CLASSES = "".join(c * len(letters) for c, letters in SOUND_CLASSES.items())


def phonetic_key(name: Column) -> Column:
    """[ST13] The first letter, then the Soundex class of each later letter that has one; not cut, repeats kept."""
    letters = F.regexp_replace(F.lower(name), r"[^\p{L}]", "")
    rest = F.translate(F.regexp_replace(F.substr(letters, F.lit(2)), f"[^{_LETTERS}]", ""), _LETTERS, _CLASSES)
    return F.concat(F.substring(letters, 1, 1), rest)


def initial_class(name: Column) -> Column:
    """[JN17] The sound a name begins with: the class of its first letter, or the letter."""
    return F.translate(F.substring(F.regexp_replace(F.lower(name), r"[^\p{L}]", ""), 1, 1), _LETTERS, _CLASSES)


def _similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(range(len(b)))
    pairs = []
    for i, x in enumerate(a):
        if (j := next((j for j in free if abs(i - j) <= reach and b[j] == x), None)) is not None:
            free.remove(j)
            pairs.append((x, j))
    if not pairs:
        return 0.0
    n = len(pairs)
    swapped = sum(x != b[j] for (x, _), j in zip(pairs, sorted(j for _, j in pairs)))
    jaro = (n / len(a) + n / len(b) + (n - swapped / 2) / n) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro if jaro <= 0.7 else jaro + head * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """[ST14] Prefix of up to four with weight 0.1, only above 0.7; half transpositions aren't rounded."""
    return pd.Series([None if x is None or y is None else _similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def spoken_variants(name: Column) -> Column:
    """Every prefix of a spoken name, and each of its words."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    prefixes = F.transform(words, lambda w, i: F.array_join(F.slice(words, F.lit(1), i + 1), " "))
    return F.array_distinct(F.concat(prefixes, words))


def known_variants(name: Column) -> Column:
    """A full name, its last word, and the parts of that at hyphens."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    last = F.element_at(words, -1)
    return F.array_distinct(F.concat(F.array(F.array_join(words, " "), last), F.filter(F.split(last, "-"), lambda w: w != "")))


def _sounding(names: DataFrame, id_: str, variants: Column) -> DataFrame:
    """body_id, id, keys: the phonetic keys of all variants, sorted; a key holds no blank."""
    each = names.select("body_id", id_, F.explode(variants).alias("v")).select("body_id", id_, phonetic_key(F.col("v")).alias("k"))
    return each.groupBy("body_id", id_).agg(F.array_join(F.array_sort(F.collect_set("k")), " ").alias("keys"))


def _keys_of(names: DataFrame, whole: str, key: str) -> DataFrame:
    """body_id, whole, key, sound: each set of keys of a body once, by its keys."""
    each = names.select("body_id", F.col("keys").alias(whole)).distinct().select("body_id", whole, F.explode(F.split(whole, " ", -1)).alias(key))
    return each.withColumn("sound", initial_class(F.col(key)))


def match_names(spoken: DataFrame, officials: DataFrame) -> DataFrame:
    """[JN17] spoken_id, spoken, person_id, score, runner_up, passed: the official whose name sounds most like each spoken name.

    Variants meet only where they begin with the same sound and both are of one body (an equi join, so no pair of bodies is
    formed). A name sounds as its set of keys does: each set of a body is asked once, officials of one set go on as the two first of
    them, equal pairs of keys are scored once, and the best and second are picked by aggregates."""
    said = _sounding(spoken, "spoken_id", spoken_variants(F.col("spoken")))
    known = _sounding(officials, "person_id", known_variants(F.col("name")))
    first = Window.partitionBy("body_id", "keys").orderBy("person_id")
    known_ids = known.withColumn("r", F.row_number().over(first)).where("r <= 2").select("body_id", F.col("keys").alias("known"), "person_id")
    ks, kk = _keys_of(said, "asked", "ks"), _keys_of(known, "known", "kk")
    pairs = ks.join(kk.hint("merge"), ["body_id", "sound"]).select("body_id", "asked", "known", "ks", "kk")
    scored = pairs.select("ks", "kk").distinct().withColumn("score", jaro_winkler("ks", "kk"))
    alike = pairs.join(scored, ["ks", "kk"]).groupBy("body_id", "asked", "known").agg(F.max("score").alias("score"))
    best = alike.join(known_ids.hint("merge"), ["body_id", "known"])
    rank = Window.partitionBy("body_id", "asked").orderBy(F.desc("score"), "person_id")
    two = best.withColumn("r", F.row_number().over(rank)).where("r <= 2")
    top = two.groupBy("body_id", "asked").agg(F.max(F.when(F.col("r") == 1, F.col("person_id"))).alias("person_id"), F.round(F.max("score"), 4).alias("score"), F.round(F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)), 4).alias("runner_up"))
    top = said.withColumnRenamed("keys", "asked").join(top.hint("merge"), ["body_id", "asked"]).drop("asked")
    passed = (F.col("score") >= LEAST_SCORE) & (F.col("score") - F.col("runner_up") >= LEAST_LEAD)
    return spoken.join(top.hint("merge"), ["body_id", "spoken_id"], "left").select("body_id", "spoken_id", "spoken", "person_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"), F.coalesce(passed, F.lit(False)).alias("passed"))
