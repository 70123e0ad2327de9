"""Chat formatting: turns of a conversation to one training string with a loss mask.

The work is relational: turns are collected as structs and sorted, neighbouring
turns of one role become one message, and messages are concatenated, all with
Spark expressions.

Template, for each message::

    <|im_start|> role <|im_sep|> text [<|im_next|> text]... <|im_end|>

(without the blanks). ``<|im_next|>`` stands between turns that were merged, so
the original turns can be read back. In roles and texts a backslash is doubled,
and a backslash is put after the first character of each control string; no
control string is then left inside a text, and ``unescape`` restores it.

Defined results: null text and null role are read as empty; rows of one
conversation are ordered by turn (null first), then role, then text, so repeated
turn numbers have a fixed order and repeated rows stay; rows with a null
conversation id form one conversation; an empty table gives no rows; columns
other than the four are ignored. A conversation is one output row, so it has to
fit into one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.tables import table


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings. ``foreign`` are escaped too: other templates' marks that a tokenizer may treat as special."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    next: str = "<|im_next|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.start, self.sep, self.next, self.end)
        if len(set(marks)) < 4 or any(len(x) < 2 or "\\" in x or x[0] in x[1:] for x in marks):
            raise ValueError("marks must differ, have two characters or more, no backslash, and not repeat their first character")
        if any(a != b and a in b for a in marks for b in marks) or any(len(x) < 2 or "\\" in x for x in self.foreign):
            raise ValueError("a mark must not lie inside another; control strings need two characters and no backslash")
        if len({x[0] for x in marks}) > 1 or any(marks[0][0] in x[1:] for x in marks):
            raise ValueError("marks must begin with one character that occurs nowhere else in them")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.next, self.end, *self.foreign)


def _literal(text: str) -> str:
    return "".join(c if re.match(r"[\w ]", c) else "\\" + c for c in text)


def escape(text: Column, template: ChatTemplate) -> Column:
    heads = "|".join(f"{_literal(x[0])}(?={_literal(x[1:])})" for x in template.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), heads, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``messages``, ``pieces`` (text, loss) and ``formatted``.

    ``formatted`` is the pieces' texts in order; the loss mask is true on pieces with ``loss``.
    """
    t = template or ChatTemplate()
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    starts = turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )
    messages = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, j: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s), lambda x: x["text"]
                ).alias("texts"),
            ),
        ).alias("messages"),
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def message_pieces(m: Column) -> Column:
        no = F.lit(False)
        body = F.flatten(
            F.transform(
                m["texts"],
                lambda x, i: F.array(
                    piece(F.when(i == 0, F.lit("")).otherwise(F.lit(t.next)), no),
                    piece(escape(x, t), m["role"].isin(*t.loss_roles)),
                ),
            )
        )
        head = F.concat(F.lit(t.start), escape(m["role"], t), F.lit(t.sep))
        return F.concat(F.array(piece(head, no)), body, F.array(piece(F.lit(t.end), no)))

    pieces = messages.select("conv_id", "messages", F.flatten(F.transform("messages", message_pieces)).alias("pieces"))
    return pieces.withColumn("formatted", F.concat_ws("", F.transform("pieces", lambda p: p["text"])))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) that a formatted string holds, in order."""
    t = template or ChatTemplate()
    blocks = F.filter(F.split(formatted, _literal(t.start)), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        body = F.substring_index(block, t.end, 1)
        halves = F.split(body, _literal(t.sep), 2)
        return F.transform(
            F.split(F.get(halves, F.lit(1)), _literal(t.next)),
            lambda s: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(s).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted; figures read back from the formatted strings and masks."""
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(rows)
    read = out.select(
        "conv_id",
        "formatted",
        F.size("messages").cast("long").alias("n_messages"),
        read_back(F.col("formatted")).alias("turns"),
        unescape(F.concat_ws("", F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: p["text"]))).alias("loss"),
    )
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )


def _sql() -> str:
    t = ChatTemplate()
    quoted = ["'" + x + "'" for x in t.controls]

    def grown(c: str) -> str:  # code points of c once escaped
        marks = " + ".join(f"(length({c}) - length(replace({c}, {q}, ''))) // length({q})" for q in quoted)
        return f"(length({c}) + length({c}) - length(replace({c}, '\\', '')) + {marks})"

    head, nxt, end = len(t.start) + len(t.sep), len(t.next), len(t.end)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, TRUE) AS opens FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({grown("text")} + CASE WHEN opens THEN {head + end} + {grown("role")} ELSE {nxt} END)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE opens) AS n_messages
FROM marked GROUP BY conv_id
"""


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE_SQL = {"op1_chat_format": _sql()}
