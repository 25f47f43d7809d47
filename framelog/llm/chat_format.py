"""Chat formatting of preference pairs.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt; what is left of each
is its completion, with the spans of assistant text that a loss may see. Everything else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is rendered as head, role, neck, text, tail.
HEAD, NECK, TAIL = "<|", "|>\n", "<|end|>\n"


def gather(turns: DataFrame) -> DataFrame:
    """(pair, conv_id, turns array<struct<turn, role, text>>), in the order of turn, role, text; nulls first. Conversations that differ in the
    last bit of conv_id are a pair, and lie together: one exchange serves this and ``swapped_replies``.

    Null roles and texts become empty. Turns without a conv_id belong to no conversation and are left out. A conversation is
    one row from here on, as it is in the result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.where("conv_id is not null").withColumn("pair", F.shiftright("conv_id", 1)).repartition("pair")
    return dealt.groupBy("pair", "conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _rendered(turns: str) -> str:
    return f"transform({turns}, t -> concat('{HEAD}', t.role, '{NECK}', t.text, '{TAIL}'))"


def _spans(turns: str) -> str:
    """'start:length' of each assistant turn's text and tail in the rendered turns, in code points."""
    fixed = len(HEAD) + len(NECK)
    step = f"length(t.role) + length(t.text) + {fixed + len(TAIL)}"
    span = f"concat(a.at + length(t.role) + {fixed}, ':', length(t.text) + {len(TAIL)})"
    return (
        f"array_join(aggregate({turns}, named_struct('at', 0L, 'spans', cast(array() as array<string>)), (a, t) -> named_struct("
        f"'at', a.at + {step}, 'spans', if(t.role = 'assistant', concat(a.spans, array({span})), a.spans))).spans, ',')"
    )


def preference_format(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected; arrays of struct<turn, role, text>) as prompt and masked completions.

    Returns pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask. Turns are equal when role and text are;
    turn numbers don't count. A null array is an empty conversation. If one conversation is a prefix of the other its
    completion is empty. Masks list the spans that are NOT masked.
    """
    both = pairs.select("pair_id", *[F.coalesce(c, F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")).alias(c) for c in ("chosen", "rejected")])
    same: Column = F.expr(
        "array_position(concat(transform(slice(chosen, 1, least(size(chosen), size(rejected))), (t, i) -> "
        "t.role <=> rejected[i].role and t.text <=> rejected[i].text), array(false)), false) - 1"
    )
    both = both.withColumn("n_prompt_turns", same)
    rest = lambda c: F.expr(f"slice({c}, cast(n_prompt_turns as int) + 1, size({c}))")
    both = both.withColumn("prefix", F.expr("slice(chosen, 1, cast(n_prompt_turns as int))")).withColumns({"chosen": rest("chosen"), "rejected": rest("rejected")})
    text = {c: F.array_join(F.expr(_rendered(c)), "") for c in ("prefix", "chosen", "rejected")}
    return both.select(
        "pair_id", "n_prompt_turns", text["prefix"].alias("prompt"), text["chosen"].alias("chosen"), F.expr(_spans("chosen")).alias("chosen_mask"),
        text["rejected"].alias("rejected"), F.expr(_spans("rejected")).alias("rejected_mask"),
    )


def swapped_replies(convs: DataFrame) -> DataFrame:
    """A pair for each conversation of ``gather``: it is chosen; rejected is the same with its last assistant turn (and what follows)
    replaced by the last assistant turn of its neighbour, conv_id xor 1. Without a neighbour or a reply, nothing takes its place."""
    last = "filter(turns, t -> t.role = 'assistant')[size(filter(turns, t -> t.role = 'assistant')) - 1]"
    at = "coalesce(array_max(transform(turns, (t, i) -> if(t.role = 'assistant', i, null))), size(turns))"
    reply = F.expr(f"if(exists(turns, t -> t.role = 'assistant'), array({last}), slice(turns, 1, 0))")
    by = Window.partitionBy("pair").orderBy("conv_id")  # two rows at most
    joined = convs.withColumn("own", reply).withColumn("reply", F.coalesce(F.lag("own").over(by), F.lead("own").over(by)))
    rejected = F.expr(f"concat(slice(turns, 1, {at}), coalesce(reply, slice(turns, 1, 0)))")
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


SQL = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (
  SELECT conv_id, turns, list_filter(turns, lambda t: t.role = 'assistant') AS replies,
    coalesce(list_max(list_transform(turns, lambda t, i: CASE WHEN t.role = 'assistant' THEN i - 1 END)), len(turns)) AS last_at
  FROM c),
p AS (
  SELECT a.conv_id AS pair_id, a.turns AS chosen, list_concat(a.turns[1:a.last_at], coalesce(b.replies[len(b.replies):len(b.replies)], [])) AS rejected
  FROM r a LEFT JOIN r b ON a.conv_id = xor(b.conv_id, 1)),
n AS (
  SELECT *, list_position(list_concat(list_transform(range(1, least(len(chosen), len(rejected)) + 1),
    lambda i: chosen[i].role = rejected[i].role AND chosen[i].text = rejected[i].text), [false]), false) - 1 AS k FROM p),
s AS (SELECT pair_id, k, chosen[1:k] AS a, chosen[k + 1:] AS b, rejected[k + 1:] AS c FROM n),
x AS (
  SELECT *, list_transform(a, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS ra,
    list_transform(b, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS rb,
    list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS rc FROM s)
SELECT pair_id, k::BIGINT AS n_prompt_turns, coalesce(array_to_string(ra, ''), '') AS prompt,
  coalesce(array_to_string(rb, ''), '') AS chosen, coalesce(array_to_string(list_filter(list_transform(b, lambda t, i: CASE WHEN t.role = 'assistant' THEN
    (coalesce(list_sum(list_transform(rb[1:i - 1], lambda z: length(z))), 0)::BIGINT + length(t.role) + 5)::VARCHAR || ':' || (length(t.text) + 8)::VARCHAR END), lambda z: z IS NOT NULL), ','), '') AS chosen_mask,
  coalesce(array_to_string(rc, ''), '') AS rejected, coalesce(array_to_string(list_filter(list_transform(c, lambda t, i: CASE WHEN t.role = 'assistant' THEN
    (coalesce(list_sum(list_transform(rc[1:i - 1], lambda z: length(z))), 0)::BIGINT + length(t.role) + 5)::VARCHAR || ':' || (length(t.text) + 8)::VARCHAR END), lambda z: z IS NOT NULL), ','), '') AS rejected_mask
FROM x
"""
