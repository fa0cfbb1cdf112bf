"""Preference data: a common prompt and two masked completions.

Two conversations, the chosen and the rejected, share their first turns. These are
rendered once, as the prompt; what follows in either is its completion. A mask
names the parts of a completion that are learnt: the assistant's own words, and
the mark that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import free_name

OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.coalesce(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]), F.lit(False)))
    return differs[0]


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(BETWEEN), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))), "")


def mask(turns: Column, learnt: str = "assistant") -> Column:
    """(from, to) in characters of the rendered turns: text and closing mark of the learnt role's turns."""
    size = lambda t: F.length(rendered(F.array(t)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def add(acc, t):
        end = acc["at"] + size(t)
        start = acc["at"] + F.lit(len(OPEN) + len(BETWEEN)) + F.length(F.coalesce(t["role"], F.lit("")))
        span = F.array(F.struct(start.cast("int").alias("from"), (end - 1).cast("int").alias("to")))  # without the line end
        return F.struct(end.cast("int").alias("at"), F.when(t["role"].eqNullSafe(learnt), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", learnt: str = "assistant") -> DataFrame:
    """`pairs` with n_prompt_turns, prompt, chosen_completion, rejected_completion, chosen_mask and rejected_mask.

    The input's turn columns are arrays of (role, text), in order; null counts as
    no turns, a null role or text as the empty string when rendered (but differs
    from it when compared). Equal conversations have empty completions.
    """
    turns = lambda c: F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS))
    c, r = free_name(pairs, "_c"), free_name(pairs, "_r")
    rows = pairs.withColumns({c: turns(chosen), r: turns(rejected)})
    rows = rows.withColumn("n_prompt_turns", common_turns(F.col(c), F.col(r)))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    rows = rows.withColumns({"prompt": rendered(F.slice(c, F.lit(1), F.col("n_prompt_turns"))), c: rest(c), r: rest(r)})
    rows = rows.withColumns({"chosen_completion": rendered(F.col(c)), "rejected_completion": rendered(F.col(r)), "chosen_mask": mask(F.col(c), learnt), "rejected_mask": mask(F.col(r), learnt)})
    return rows.drop(c, r)


def conversation_pairs(turns: DataFrame, reply: str = "assistant") -> DataFrame:
    """Pairs from a table of turns (conv_id, turn, role, text): (conv_id, chosen, rejected).

    Chosen is the conversation. Rejected is the same up to its last reply, and
    there has the last reply of its neighbour (conv_id with the lowest bit
    flipped), or an empty one if that has none. Conversations without a reply
    give no pair. Turns with a null conv_id are left out; equal turn numbers are
    ordered by role and text. A conversation is one row, as it is one text.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    at = F.array_max(F.transform("t", lambda x, i: F.when(x["role"].eqNullSafe(reply), i).otherwise(-1)))
    whole = whole.withColumn("_at", at).filter("_at >= 0").select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("chosen"), "_at")
    other = whole.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("conv_id"), F.get("chosen", F.col("_at")).alias("_other"))
    both = whole.join(other, "conv_id", "left")
    last = F.coalesce("_other", F.struct(F.lit(reply).alias("role"), F.lit("").alias("text")))
    return both.select("conv_id", "chosen", F.concat(F.slice("chosen", F.lit(1), F.col("_at")), F.array(last)).alias("rejected"))


def digest(formatted: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["from"], s["to"])), ",")
    return formatted.select("conv_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


SQL = r"""with t as (select cast(conv_id as bigint) as conv_id, row_number() over (partition by conv_id order by turn, role, text) as i, role, text from conversations where conv_id is not null),
  k as (select conv_id, max(i) filter (role = 'assistant') as la, max(i) as n from t group by conv_id),
  c as (select t.*, la, n from t join k using (conv_id) where la is not null),
  o as (select xor(conv_id, 1) as conv_id, role, text from c where i = la),
  r as (select conv_id, i, role, text from c where i < la
    union all select k.conv_id, la, coalesce(o.role, 'assistant'), case when o.conv_id is null then '' else o.text end from k left join o using (conv_id) where la is not null),
  d as (select c.conv_id, min(c.i) filter (r.conv_id is null or c.role is distinct from r.role or c.text is distinct from r.text) - 1 as first_diff, any_value(c.n) as n from c left join r using (conv_id, i) group by c.conv_id),
  p as (select conv_id, coalesce(first_diff, n) as np from d),
  f as (select 'c' as side, conv_id, i, role, text from c union all select 'r', conv_id, i, role, text from r),
  g as (select side, f.conv_id, i, np, coalesce(role, '') as role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as x from f join p using (conv_id)),
  h as (select *, case when i > np then sum(length(x)) over (partition by side, conv_id, i > np order by i) end as upto from g),
  s as (select side, conv_id, any_value(np) as np, coalesce(string_agg(x, '' order by i) filter (i <= np), '') as prompt, coalesce(string_agg(x, '' order by i) filter (i > np), '') as rest,
    coalesce(string_agg((upto - length(x) + 5 + length(role))::bigint || '-' || (upto - 1)::bigint, ',' order by i) filter (i > np and role = 'assistant'), '') as m from h group by side, conv_id)
  select a.conv_id, a.np as n_prompt_turns, a.prompt, a.rest as chosen_completion, b.rest as rejected_completion, a.m as chosen_mask, b.m as rejected_mask
  from s a join s b on a.conv_id = b.conv_id and a.side = 'c' and b.side = 'r'"""
