"""Windowed full-text search: windows of one to three lines, AND and phrase match, BM25, one hit a mention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import search_terms

LINES = 3
#: Windows read for each hit asked for: one mention lies in up to so many.
OVER_FETCH = LINES * (LINES + 1) // 2
#: BM25's constants and the least weight of a word.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def windows(lines: DataFrame) -> DataFrame:
    """[WN2, WN4, JN12, FT3] Each line with up to two before it: transcript_id, last_id, span, first_pos, last_pos, text.

    One sort a transcript; the lengths come from an array, not from a cross join. lines: transcript_id, id, start_ms, text."""
    order = Window.partitionBy("transcript_id").orderBy("start_ms", "id")
    placed = lines.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    for back in range(1, LINES):
        placed = placed.withColumn(f"t{back}", F.lag("text", back).over(order))
    spans = [F.when(F.col("pos") >= n - 1, F.struct(F.lit(n).alias("span"), F.concat_ws(" ", *[F.col(f"t{i}") for i in range(n - 1, 0, -1)], F.col("text")).alias("text"))) for n in range(1, LINES + 1)]
    wide = placed.select("transcript_id", F.col("id").alias("last_id"), "pos", F.explode(F.array_compact(F.array(*spans))).alias("w"))
    return wide.select("transcript_id", "last_id", F.col("w.span").alias("span"), (F.col("pos") - F.col("w.span") + 1).alias("first_pos"), F.col("pos").alias("last_pos"), F.col("w.text").alias("text"))


def touched_windows(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """[WN3] The windows of the transcripts that changed, made anew; the rest of an index stays as it is."""
    return windows(lines.join(changed.select("transcript_id").distinct(), "transcript_id", "left_semi"))


def query_terms(q: str) -> list[str]:
    """[FT4] Words of a question: runs of letters and digits, lower case; signs and operators aren't special."""
    import re

    return [w.lower() for w in re.findall(r"[^\W_]+", q or "")]


def matches_all(tokens: Column, terms: list[str]) -> Column:
    """[FT5] Whether every term is there. No terms match nothing."""
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, terms)))) == len(set(terms)) if terms else F.lit(False)


def matches_phrase(tokens: Column, terms: list[str]) -> Column:
    """[FT6] Whether the terms stand side by side in their order."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(terms)} ")) if terms else F.lit(False)


def _is(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, key: list[str], terms: list[str], top: int | None = None, where: Column | None = None) -> DataFrame:
    """[FT7, SL1] key, score (lower is better) of the rows of docs (key, text) that hold every term.

    Corpus size, mean length and the terms' document frequencies come from one aggregate over all rows. A repeated
    term counts again. `where` then leaves rows out, and with `top`, only the best rows go on, by (score, key), before
    anything is joined to them."""
    docs = docs.withColumn("_in", F.lit(True) if where is None else where)
    tokens = docs.select(*key, "_in", search_terms(F.col("text")).alias("_t"))
    counts = {t: F.size(F.filter("_t", _is(t))) for t in dict.fromkeys(terms)}
    counted = tokens.select(*key, "_in", F.size("_t").alias("_n"), *[c.alias(f"_c{i}") for i, c in enumerate(counts.values())])
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_c{i}") > 0).alias(f"_d{i}") for i in range(len(counts))])
    hit = counted.where("_in").where(F.expr(" AND ".join(f"_c{i} > 0" for i in range(len(counts))) or "false")).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(counts):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)))
        tf = F.col(f"_c{i}") * (K1 + 1) / (F.col(f"_c{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
        score = score - idf * tf * terms.count(t)
    out = hit.select(*key, F.round(score, 6).alias("score"))
    return out.orderBy("score", *key).limit(max(0, top)) if top is not None else out


def one_hit_per_mention(hits: DataFrame) -> DataFrame:
    """[SL7] Of overlapping windows of a transcript the tightest: phrase first, then shortest, best score, first place.

    hits: transcript_id, last_id, span, first_pos, last_pos, phrase, score. Greedy choice needs order, so each transcript's
    hits (a handful for any query's limit) go to one function call."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["phrase", "span", "score", "first_pos"], ascending=[False, True, True, True])
        taken: list[tuple[int, int]] = []
        keep = []
        for a, b in zip(rows.first_pos, rows.last_pos):
            free = all(b < x or y < a for x, y in taken)
            keep.append(free)
            if free:
                taken.append((a, b))
        return rows[keep]

    return hits.groupBy("transcript_id").applyInPandas(choose, hits.schema)


def search_lines(lines: DataFrame, q: str, limit: int, transcripts: DataFrame | None = None) -> DataFrame:
    """[FT10] The best windows of the transcripts for a question, one a mention: ranked, cut, then joined and thinned.

    As in the system rebuilt here the cut to OVER_FETCH * limit comes before phrases are preferred. transcripts: only these
    transcript_ids count; they are chosen before the cut. limit <= 0: nothing."""
    terms = query_terms(q)
    index = windows(lines)
    key = ["transcript_id", "last_id", "span"]
    asked = index
    if transcripts is not None:
        asked = index.join(transcripts.select("transcript_id", F.lit(True).alias("_ok")).distinct(), "transcript_id", "left")
    ranked = bm25(asked, key, terms, OVER_FETCH * max(0, limit), None if transcripts is None else F.coalesce("_ok", F.lit(False))) if terms else None
    if ranked is None:
        return index.where("false").select(*key, "first_pos", "last_pos", F.lit(False).alias("phrase"), F.lit(0.0).alias("score"))
    joined = index.join(F.broadcast(ranked), key)  # at most OVER_FETCH * limit rows
    hits = joined.select(*key, "first_pos", "last_pos", matches_phrase(search_terms(F.col("text")), terms).alias("phrase"), "score")
    return one_hit_per_mention(hits).orderBy(F.desc("phrase"), "span", "score", "transcript_id", "first_pos").limit(max(0, limit))


def snippet(text: Column, terms: list[str], size: int = 12) -> Column:
    """[FT8] Up to `size` tokens around the first match, with an ellipsis on each side that is cut."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    folded = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    first = F.array_min(F.transform(F.array(*map(F.lit, terms)), lambda t: F.nullif(F.array_position(folded, t), F.lit(0).cast("long"))))
    n = F.size(words)
    start = F.greatest(F.lit(1), F.least(F.coalesce(first, F.lit(1)) - size // 2 - 1, n - size + 1)).cast("int")
    body = F.array_join(F.slice(words, start, F.lit(size)), " ")
    return F.concat(F.when(start > 1, " ... ").otherwise(""), body, F.when(start + size <= n, " ... ").otherwise(""))


def citation(origin: str, id_: Column, text: Column, terms: list[str]) -> Column:
    """[FT12] What a hit is cited by: origin, id, sha256 of the text, and an excerpt."""
    return F.struct(F.lit(origin).alias("origin"), id_.alias("id"), F.sha2(text, 256).alias("sha256"), snippet(text, terms).alias("excerpt"))


def unified(lines: DataFrame, pages: DataFrame, q: str, limit: int, transcripts: DataFrame | None = None, pages_in: Column | None = None, pages_only: bool = False) -> DataFrame:
    """[FT9, FT11, SL8] position, origin, transcript_id, last_id, span, id, score, citation: the best windows of lines, one a mention, then the best
    pages, together cut at the limit.

    lines: transcript_id, id, start_ms, text; pages: id, ..., text. Each kind is ranked over its own corpus; filters (the transcripts that
    count, a test of pages) come before each cut. pages_only leaves lines out. limit <= 0, or a question without words: nothing."""
    terms, limit = query_terms(q), max(0, limit)
    order = Window.orderBy("place_of_kind", "place")  # at most 2 * limit rows
    spoken = search_lines(lines, q if not pages_only else "", limit, transcripts)
    said = F.row_number().over(Window.orderBy(F.desc("phrase"), "span", "score", "transcript_id", "first_pos"))
    key = ["transcript_id", "last_id", "span"]
    heard = windows(lines).select(*key, "text").join(F.broadcast(spoken.withColumn("place", said)), key)
    cited = citation("line", F.concat_ws(":", *key), F.col("text"), terms or [""])
    found = heard.select(F.lit(0).alias("place_of_kind"), "place", F.lit("line").alias("origin"), *key, F.lit(None).cast(pages.schema["id"].dataType).alias("id"), "score", cited.alias("citation"))
    best = bm25(pages, ["id"], terms, limit, pages_in)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy("score", "id")))
    read = pages.select("id", "text").join(F.broadcast(placed), "id")
    blank = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in key]
    hits = found.unionByName(read.select(F.lit(1).alias("place_of_kind"), "place", F.lit("page").alias("origin"), *blank, "id", "score", citation("page", F.col("id").cast("string"), F.col("text"), terms or [""]).alias("citation")))
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("place_of_kind", "place").select("position", "origin", *key, "id", "score", "citation")
