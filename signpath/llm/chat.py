"""Chat formatting with Spark expressions only (operator 9).

Turns of a conversation are collected, sorted by (turn, role, text), and runs of the same role are merged into one
message. A formatted conversation is

    <s>  ( [INST] role [/INST] text ( <|and|> text )* </s> )*

Control strings inside roles and texts are escaped: a backslash is doubled, then one is put behind the first character
of every control string. No escaped text holds a control string, none of them starts with a
character in which another goes on, and so the output can be split at them and unescaped to give
back every turn. ``spans`` are the [start, end) code points of the assistant texts, which bear loss.

Defined cases: a null text or role is empty; a null turn sorts first; rows with a null conv_id are one conversation;
repeated rows are turns of their own; conversations without rows don't exist, so an empty table gives an empty result.
Columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings; no proper end of one may begin another."""

    start: str = "<s>"
    open: str = "[INST]"
    body: str = "[/INST]"
    joint: str = "<|and|>"
    close: str = "</s>"
    loss_role: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return [self.start, self.open, self.body, self.joint, self.close]


def escape(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, formatted, spans of every conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Each text's place is a running sum over the sorted turns, so that work grows with their number and not with its square.
    run = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    other = lambda near: F.coalesce(near != F.col("role"), F.lit(True))
    head = lambda role: F.concat(F.lit(t.open), escape(role, t), F.lit(t.body))
    rows = rows.withColumns({"gap": F.when(other(F.lag("role").over(run)), F.length(head(F.col("role")))).otherwise(len(t.joint)), "rest": F.when(other(F.lead("role").over(run)), len(t.close)).otherwise(0), "size": F.length(escape(F.col("text"), t))})
    rows = rows.withColumn("end", (F.sum(F.col("gap") + F.col("size") + F.col("rest")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + len(t.start) - F.col("rest")).cast("int"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", (F.col("end") - F.col("size")).alias("start"), "end"))).alias("turns"))
    fresh = lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"])
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), fresh)
    rows = rows.withColumn("starts", starts)
    stop = lambda i: F.coalesce(F.get("starts", i + 1), F.size("turns"))
    # A message is its role and its escaped texts: one slice of the sorted turns.
    rows = rows.withColumn("messages", F.transform("starts", lambda s, i: F.struct(F.get("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, stop(i) - s), lambda x: escape(x["text"], t)).alias("texts"))))
    formatted = F.concat(F.lit(t.start), F.array_join(F.transform("messages", lambda m: F.concat(head(m["role"]), F.array_join(m["texts"], t.joint), F.lit(t.close))), ""))
    spans = F.transform(F.filter("turns", lambda x: x["role"] == t.loss_role), lambda x: F.struct(x["start"], x["end"]))
    return rows.select("conv_id", formatted.alias("formatted"), spans.alias("spans"))


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """Adds to the output of ``format_conversations``, from its text and spans alone: turns (role, text) and loss_text."""
    quote = lambda c: r"\Q" + c + r"\E"
    body = F.expr(f"substring(formatted, {len(t.start) + 1})")
    messages = F.filter(F.split(body, quote(t.close)), lambda m: m != "")
    role = lambda m: F.substring_index(F.substring(m, len(t.open) + 1, 2**30), t.body, 1)
    text = lambda m: F.substring(m, F.length(role(m)) + len(t.open) + len(t.body) + 1, F.lit(2**30))
    of = lambda m: F.transform(F.split(text(m), quote(t.joint)), lambda x: F.struct(unescape(role(m)).alias("role"), unescape(x).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumns({"turns": F.flatten(F.transform(messages, of)), "loss_text": loss})


def digests(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """The digest columns of every conversation, read back from its formatted text."""
    got = read_back(format_conversations(turns, t), t)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def sample_conversation(spark, like: DataFrame) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string").select(*[F.col(c).cast(like.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")])


def oracle(t: Template = Template()) -> str:
    """DuckDB SQL for ``digests`` over conversations and conversation -7, by window functions over plain rows."""
    esc = lambda x: "".join(["replace(" * (len(t.controls) + 1), x, r", '\', '\\')", *[f", '{c}', '{c[0]}\\{c[1:]}')" for c in t.controls]])
    return f"""
    WITH rows_ AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    placed AS (SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS fresh FROM rows_
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = '{t.loss_role}'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{t.loss_role}'), '')) AS loss_sha256,
      CAST({len(t.start)} + sum(length({esc('text')}) + CASE WHEN fresh THEN length({esc('role')}) + {len(t.open + t.body + t.close)} ELSE {len(t.joint)} END) AS BIGINT) AS formatted_chars
    FROM placed GROUP BY conv_id"""
