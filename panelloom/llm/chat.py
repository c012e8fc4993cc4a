"""Preference formatting of chat data, in built-in functions only.

A pair of conversations, chosen and rejected, is split at the longest common prefix of turns.  The prefix
is rendered once as the prompt; what follows is rendered for either side as a completion with a mask of
run lengths (code points, loss yes or no): bodies of assistant turns count, headers and others do not.

One shuffle gathers the turns of a conversation, which is the unit of output.

Defined cases: turns are ordered by (turn, role, text), nulls first, so repeated turn numbers and rows
have one order; null roles and texts render as empty; turns without a conversation id belong to no
conversation and are left out; a conversation without an assistant turn is all prompt with two empty
completions; equal sides give empty completions; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("")), F.lit(SEP))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_mask(turns: Column, trained_role: str = "assistant") -> Column:
    """Run lengths over the rendered turns: array of (length, loss)."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.char_length(_head(t)).alias("length"), F.lit(False).alias("loss")),
                F.struct(F.char_length(_body(t)).alias("length"), F.coalesce(t["role"] == trained_role, F.lit(False)).alias("loss")),
            ),
        )
    )


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns, by role and text."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    places = F.when(shorter > 0, F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    differing = F.filter(
        places,
        lambda i: ~(F.get(chosen, i)["role"].eqNullSafe(F.get(rejected, i)["role"]) & F.get(chosen, i)["text"].eqNullSafe(F.get(rejected, i)["text"])),
    )
    return F.coalesce(F.array_min(differing), shorter)


def gather_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: the key and its ordered turns."""
    return (
        turns.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen, rejected), arrays of turns, to prompt, completions and masks."""
    pairs = pairs.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {s: F.slice(s, F.col("n_prompt_turns") + 1, F.greatest(F.size(s) - F.col("n_prompt_turns"), F.lit(0))) for s in ("chosen", "rejected")}
    return pairs.select(
        "pair_id",
        "n_prompt_turns",
        render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        render(rest["chosen"]).alias("chosen"),
        render(rest["rejected"]).alias("rejected"),
        loss_mask(rest["chosen"]).alias("chosen_mask"),
        loss_mask(rest["rejected"]).alias("rejected_mask"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """Two tables of turns that share ``key``; a side that is missing counts as having no turns."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    left = gather_turns(chosen, key).select(F.col(key).alias("pair_id"), F.col("turns").alias("chosen"))
    right = gather_turns(rejected, key).select(F.col(key).alias("pair_id"), F.col("turns").alias("rejected"))
    both = left.join(right, "pair_id", "full")
    return format_pairs(both.select("pair_id", *[F.coalesce(s, none).alias(s) for s in ("chosen", "rejected")]))


def pairs_from_conversations(conversations: DataFrame, whole: bool = False) -> DataFrame:
    """A pair per conversation where no preferences are given.

    Chosen is the conversation; in rejected its last assistant turn carries the last reply of the neighbouring
    conversation (ids 2k and 2k+1 are neighbours; empty if there is none).  With ``whole`` the turns after
    that reply follow on both sides, without loss, as none of them is an assistant's; else they are left out.
    """
    convs = gather_turns(conversations)
    places = F.when(F.size("turns") > 0, F.sequence(F.lit(1), F.size("turns"))).otherwise(F.array().cast("array<int>"))
    last = F.array_max(F.filter(places, lambda i: F.coalesce(F.element_at("turns", i)["role"] == "assistant", F.lit(False))))
    convs = convs.withColumn("last", last)
    replies = convs.filter("last is not null").select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.coalesce(F.element_at("turns", F.col("last"))["text"], F.lit("")).alias("reply")
    )
    convs = convs.join(replies, "conv_id", "left")
    kept = F.col("turns") if whole else F.slice("turns", F.lit(1), F.coalesce(F.col("last"), F.size("turns")))
    swapped = F.transform(
        kept,
        lambda t, i: F.struct(
            t["turn"].alias("turn"), t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.coalesce("reply", F.lit(""))).otherwise(t["text"]).alias("text")
        ),
    )
    return convs.select(F.col("conv_id").alias("pair_id"), kept.alias("chosen"), swapped.alias("rejected"))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, text AS raw, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(i) AS n, max(i) FILTER (WHERE r = 'assistant') AS la FROM t GROUP BY conv_id),
rep AS (SELECT t.conv_id, t.x FROM t JOIN a ON t.conv_id = a.conv_id AND t.i = a.la),
c AS (SELECT t.conv_id, t.i, t.r, t.raw, t.x, a.la,
             CASE WHEN t.i = a.la THEN coalesce(p.x, '') ELSE t.raw END AS y
      FROM t JOIN a ON t.conv_id = a.conv_id LEFT JOIN rep p ON p.conv_id = xor(t.conv_id, 1)),
k AS (SELECT conv_id, CASE WHEN bool_and(raw IS NOT DISTINCT FROM y) THEN max(i) ELSE any_value(la) - 1 END AS np FROM c GROUP BY conv_id),
m AS (SELECT c.conv_id, c.i, c.r, k.np, '<|im_start|>' || c.r || chr(10) AS h, c.x || '<|im_end|>' || chr(10) AS bc,
             coalesce(c.y, '') || '<|im_end|>' || chr(10) AS br
      FROM c JOIN k ON c.conv_id = k.conv_id)
SELECT conv_id AS pair_id, any_value(np)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(h || bc, '' ORDER BY i) FILTER (WHERE i <= np), '') AS prompt,
  coalesce(string_agg(h || bc, '' ORDER BY i) FILTER (WHERE i > np), '') AS chosen,
  coalesce(string_agg(h || br, '' ORDER BY i) FILTER (WHERE i > np), '') AS rejected,
  coalesce(string_agg(length(h) || ':0,' || length(bc) || CASE WHEN r = 'assistant' THEN ':1' ELSE ':0' END, ',' ORDER BY i) FILTER (WHERE i > np), '') AS chosen_mask,
  coalesce(string_agg(length(h) || ':0,' || length(br) || CASE WHEN r = 'assistant' THEN ':1' ELSE ':0' END, ',' ORDER BY i) FILTER (WHERE i > np), '') AS rejected_mask
FROM m GROUP BY conv_id
"""
