"""Chat formatting of reply trees.

Messages point to the message that they reply to. Iterative self-joins enumerate the path from the root
to each leaf: jump tables to the 1st, 2nd, 4th, ... ancestor, each the self-join of the last, let every leaf
reach all its ancestors after a logarithmic number of joins. Branches of a conversation are ranked by
score, and each chosen path becomes one formatted conversation with a loss mask over assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

START, END = "<|im_start|>", "<|im_end|>"
LONG = "bigint"
#: Strings that steer a chat template: those of this template and those in common use elsewhere. A text may
#: hold them with any number of backslashes after the opening character; escaping adds one, unescaping takes one.
CONTROL = r"([<\[])(\\*)((?:\|[A-Za-z0-9_-]+\|>)|(?:(?:start|end)_of_turn>)|(?:/?s>)|(?:/?INST\])|(?:/?SYS>>))"
ESCAPED = r"([<\[])\\(\\*)((?:\|[A-Za-z0-9_-]+\|>)|(?:(?:start|end)_of_turn>)|(?:/?s>)|(?:/?INST\])|(?:/?SYS>>))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role is one line without a control string."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def conversation_key() -> Column:
    """Conversations by text, with null apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def linear(turns: DataFrame) -> DataFrame:
    """A table of turns ``(conv_id, turn, role, text)`` as messages that each reply to the turn before.

    Turns of one conversation are ordered by turn, then role and text, nulls first; repeated rows follow
    one another. Null conversations form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast(LONG)
    return turns.select("conv_id", at.alias("msg_id"), F.when(at > 1, at - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of ``messages(conv_id, msg_id, parent_id, ...)``: conv_id, leaf, up, msg_id.

    ``up`` counts replies from the leaf. A message whose parent is null or missing is a root. Messages on
    a cycle, or below one, have no root and are on no path. A message id should be unique in its
    conversation; of repeated rows with one id the first parent counts. Rows with a null message id are left out.
    """
    nodes = messages.where("msg_id IS NOT NULL").groupBy(conversation_key().alias("conv"), "msg_id").agg(F.min("parent_id").alias("parent_id"))
    known = nodes.select("conv", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    nodes = settle(nodes.join(known, ["conv", "parent_id"], "left").select("conv", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("jump")))
    leaves = nodes.join(nodes.select("conv", F.col("jump").alias("msg_id")).where("msg_id IS NOT NULL").distinct(), ["conv", "msg_id"], "left_anti")
    paths = leaves.select("conv", F.col("msg_id").alias("leaf"), F.lit(0).cast(LONG).alias("up"), "msg_id")
    jumps, step = nodes.where("jump IS NOT NULL"), 1
    most = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while step < most and not jumps.isEmpty():
        further = paths.join(jumps, ["conv", "msg_id"]).select("conv", "leaf", (F.col("up") + step).alias("up"), F.col("jump").alias("msg_id"))
        paths = settle(paths.unionByName(further))
        then = jumps.select("conv", F.col("msg_id").alias("jump"), F.col("jump").alias("next"))
        jumps = settle(jumps.join(then, ["conv", "jump"]).select("conv", "msg_id", F.col("next").alias("jump")))
        step *= 2
    roots = nodes.where("jump IS NULL").select("conv", "msg_id")
    rooted = paths.join(roots, ["conv", "msg_id"], "left_semi").select("conv", "leaf").distinct()
    return paths.join(rooted, ["conv", "leaf"], "left_semi")


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row for each root-to-leaf path: conv_id, leaf, rank, score, turns and formatted.

    Branches rank by the mean score of their messages (null counts as 0), ties by leaf; ``best`` keeps so
    many of each conversation, all by default. ``turns`` are structs ``role, text``; a null text or role is
    empty. The result has the columns named here whatever else ``messages`` has.
    """
    m = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    keyed = m.withColumn("conv", conversation_key()).drop("parent_id").dropDuplicates(["conv", "msg_id"])
    held = branches(m).join(keyed, ["conv", "msg_id"])
    grouped = held.groupBy("conv", "leaf").agg(F.first("conv_id").alias("conv_id"), F.avg("score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf"))
    ranked = grouped.withColumn("rank", rank)
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    return chosen.select("conv_id", "leaf", "rank", "score", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")).withColumn("formatted", formatted(F.col("turns")))


def formatted(turns: Column) -> Column:
    """The template: each turn is a start mark, its role, a line feed, its escaped text and an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def parsed(text: Column) -> Column:
    """Turns read back from a formatted conversation, with the escaped text's place: role, text, start, end."""
    blocks = F.slice(F.split(text, F.lit(r"<\|im_end\|>\n"), -1), F.lit(1), F.size(F.split(text, F.lit(r"<\|im_end\|>\n"), -1)) - 1)
    return F.transform(blocks, lambda b: F.struct(unescape_role(F.substring_index(b.substr(F.lit(len(START) + 1), F.length(b)), "\n", 1)).alias("role"), b.substr(F.locate("\n", b) + 1, F.length(b)).alias("escaped"), F.locate("\n", b).alias("head"), F.length(b).alias("n")))


def loss_mask(text: Column, role: str = "assistant") -> Column:
    """Spans of a formatted conversation that training learns from, as structs ``start, end`` in code points."""
    placed = F.aggregate(
        parsed(text),
        F.struct(F.lit(0).cast(LONG).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, b: F.struct(
            (a["at"] + b["n"] + len(END) + 1).cast(LONG).alias("at"),
            F.when(b["role"] == role, F.concat(a["spans"], F.array(F.struct((a["at"] + b["head"]).cast(LONG).alias("start"), (a["at"] + b["n"]).cast(LONG).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return placed["spans"]


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``, all read back from the formatted text: counts, digests."""
    out = conversations(linear(turns)).select("conv_id", "formatted").withColumn("read", parsed(F.col("formatted"))).withColumn("mask", loss_mask(F.col("formatted")))
    text = F.array_join(F.transform("mask", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    flat = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["escaped"]), F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast(LONG).alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length(text).cast(LONG).alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), F.length("formatted").cast(LONG).alias("formatted_chars"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)((?:\|[A-Za-z0-9_-]+\|>)|(?:(?:start|end)_of_turn>)|(?:/?s>)|(?:/?INST\])|(?:/?SYS>>))', '\1\\\2\3', 'g') AS escaped,
    replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS named
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(named) + 1 + length(escaped) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
