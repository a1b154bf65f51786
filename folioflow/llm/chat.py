"""Operator 4: chat formatting checked by a grammar round trip. DataFrame functions only.

    conversation = ("<s>" | "<\\s>") turn*        the second head says that roles and texts are escaped
    turn         = "[INST]" role "[/INST]" text "</s>"

Roles and texts hold no control string. A conversation is first rendered as it is and parsed again; where the recovered
turns are not the source's, it is rendered escaped: a backslash is doubled, and one is put into every control string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

OPEN, MID, END = "[INST]", "[/INST]", "</s>"
HEAD, ESCAPED_HEAD = "<s>", "<\\s>"
CONTROLS = [HEAD, END, OPEN, MID]


def escape(text: Column) -> Column:
    steps = [("\\", "\\\\"), *[(c, c[0] + "\\" + c[1:]) for c in CONTROLS]]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), steps, text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: bool) -> Column:
    own = escape if escaped else (lambda t: t)
    whole = F.transform(turns, lambda x: F.concat(F.lit(OPEN), own(x["role"]), F.lit(MID), own(x["text"]), F.lit(END)))
    return F.concat(F.lit(ESCAPED_HEAD if escaped else HEAD), F.array_join(whole, ""))


def parts(formatted: Column) -> Column:
    """The rendered turns, without their ends."""
    body = F.when(formatted.startswith(ESCAPED_HEAD), F.substr(formatted, F.lit(len(ESCAPED_HEAD) + 1))).otherwise(F.substr(formatted, F.lit(len(HEAD) + 1)))
    split = F.split(body, END, -1)
    return F.slice(split, F.lit(1), F.size(split) - 1)


def _role(part: Column) -> Column:
    return F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), MID, 1)


def _text(part: Column) -> Column:
    return F.substr(part, F.length(_role(part)) + len(OPEN) + len(MID) + 1)


def parse(formatted: Column, pieces: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation whose parts are `pieces`, or null if the grammar doesn't fit."""
    free = lambda t: reduce(lambda a, c: a & ~t.contains(c), [HEAD, OPEN, MID], F.lit(True))
    fits = F.forall(pieces, lambda p: p.startswith(OPEN) & p.contains(MID) & free(_role(p)) & free(_text(p)))
    headed = formatted.startswith(HEAD) | formatted.startswith(ESCAPED_HEAD)
    plain = F.transform(pieces, lambda p: F.struct(_role(p).alias("role"), _text(p).alias("text")))
    opened = F.transform(pieces, lambda p: F.struct(unescape(_role(p)).alias("role"), unescape(_text(p)).alias("text")))
    return F.when(headed & fits & formatted.endswith(END), F.when(formatted.startswith(ESCAPED_HEAD), opened).otherwise(plain))


def loss_mask(formatted: Column, pieces: Column) -> Column:
    """array<struct<start, stop>>: half-open code point ranges of the assistant texts in a rendered conversation."""
    head = F.when(formatted.startswith(ESCAPED_HEAD), len(ESCAPED_HEAD)).otherwise(len(HEAD)).cast("long")
    start = F.struct(head.alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        stop = (state["at"] + F.length(p)).cast("long")
        span = F.struct((stop - F.length(_text(p))).cast("long").alias("start"), stop.alias("stop"))
        spans = F.when(_role(p) == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((stop + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def format_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (read back), mask, escaped, identical for each conversation.

    Turns are ordered by (turn, role, text). Null roles and texts are empty; rows without conv_id are one conversation;
    repeated rows are turns of their own; an empty table gives an empty result; extra columns are ignored. A conversation
    is one row, so its turns must fit a task, as any rendered text must."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = chats.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    source = grouped.select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    first = source.withColumn("plain", render(F.col("source"), False))
    tried = first.withColumn("back", parse(F.col("plain"), parts(F.col("plain"))))
    chosen = tried.withColumn("formatted", F.when(F.col("back").eqNullSafe(F.col("source")), F.col("plain")).otherwise(render(F.col("source"), True)))
    split = chosen.withColumn("parts", parts(F.col("formatted")))
    read = split.withColumn("turns", parse(F.col("formatted"), F.col("parts")))
    mask = loss_mask(F.col("formatted"), F.col("parts"))
    return read.select("conv_id", "formatted", "turns", mask.alias("mask"), F.col("formatted").startswith(ESCAPED_HEAD).alias("escaped"), F.col("turns").eqNullSafe(F.col("source")).alias("identical"))


def masked_text(formatted: Column, mask: Column, escaped: Column) -> Column:
    """The text under the mask, spans one after the other, unescaped where the conversation is escaped."""
    spans = F.transform(mask, lambda m: F.substr(formatted, (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))
    return F.when(escaped, F.array_join(F.transform(spans, unescape), "")).otherwise(F.array_join(spans, ""))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{probe}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    out = format_chats(chats.unionByName(extra)).withColumn("loss", masked_text(F.col("formatted"), F.col("mask"), F.col("escaped")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )


def _sql_escape(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"


_HAS = " OR ".join(f"contains({c}, '{x}')" for c in ("role", "text") for x in CONTROLS)
OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         bool_or({_HAS}) AS escaped,
         sum(17 + length(role) + length(text)) AS plain_chars,
         sum(17 + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS escaped_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(CASE WHEN escaped THEN 4 + escaped_chars ELSE 3 + plain_chars END AS BIGINT) AS formatted_chars,
       escaped, true AS identical
FROM grouped
"""
