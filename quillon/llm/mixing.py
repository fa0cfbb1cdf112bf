"""Mixing to target weights by hierarchical budgets.

The documents form a tree (domain, language, source). A token budget at the root
goes down by the weights of the children. A child gets no more than it can give
(its tokens times ``max_epochs``); what it cannot take goes to its siblings by
their weights, and only what all of them cannot take stays with the parent, where
the parent's siblings have already received it, since a node's own limit is the
sum of its leaves'. A leaf's budget is spent on whole epochs, and the rest on the
prefix of one more epoch, whose order is a seeded hash of the doc_id.

All arithmetic is on integers (tokens times weight must stay below 9e18). Only
DataFrame functions are used. A leaf is never sorted as a whole: documents are
counted by the hash's leading digits, and only the one range in which the prefix
ends is sorted. Null tree columns count as the empty string, a null text has no
tokens, repeated rows count each, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import free_name, same_text, saved, small, text_hash
from quillon.llm.rules import SPACE

#: Hexadecimal digits of the order key by which a leaf is counted.
DIGITS = 3


def n_tokens(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("bigint")


def weight_of(column: str, weights: dict[str, int], default: int = 1) -> Column:
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out.cast("bigint")


def spread(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Column got of each node: its share of its parent's ``budget``, by ``weight`` and at most ``limit``.

    Children are filled in the order of limit per weight: as long as the even
    level exceeds a child's limit it is filled, the others share what is left.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.col("limit").cast("double") / F.col("weight"), node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = nodes.withColumns({"_c": F.coalesce(F.sum("limit").over(before), F.lit(0)), "_w": F.coalesce(F.sum("weight").over(before), F.lit(0)), "_all": F.sum("weight").over(family)})
    run = run.withColumn("_full", (F.col("budget") - F.col("_c")) * F.col("weight") >= F.col("limit") * (F.col("_all") - F.col("_w")))
    run = run.withColumns({"_fc": F.sum(F.when(F.col("_full"), F.col("limit")).otherwise(0)).over(family), "_fw": F.sum(F.when(F.col("_full"), F.col("weight")).otherwise(0)).over(family)})
    part = F.expr("(budget - _fc) * weight div greatest(_all - _fw, 1)")
    return run.withColumn("got", F.when(F.col("_full"), F.col("limit")).otherwise(part)).drop("_c", "_w", "_all", "_full", "_fc", "_fw")


def budgets(leaves: DataFrame, tree: list[str], weights: dict[str, dict[str, int]], numerator: int, denominator: int, max_epochs: int) -> DataFrame:
    """Each leaf with its token budget; the root has tokens * numerator / denominator."""
    level, up = leaves, []
    for node in tree:
        here = leaves.groupBy(*up, node).agg((F.sum("tokens") * max_epochs).alias("limit")).withColumn("weight", weight_of(node, weights.get(node, {})))
        if up:
            here = here.join(level.select(*up, F.col("got").alias("budget")), up)
        else:
            here = here.withColumn("budget", F.expr(f"sum(limit) over () div {max_epochs} * {numerator} div {denominator}"))
        level = spread(here, up, node)
        up = [*up, node]
    return level.select(*tree, F.col("got").alias("budget"))


def mix(docs: DataFrame, tree: dict[str, Column], weights: dict[str, dict[str, int]], numerator: int, denominator: int, max_epochs: int, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, the tree's columns, n_tokens and copies (how often the mix holds it)."""
    names = list(tree)
    levels = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in tree.items()]
    slim = saved(docs.select("doc_id", *levels, n_tokens(F.col("text")).alias("n_tokens"), text_hash(F.col("text")).alias("text_hash")))
    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, numerator, denominator, max_epochs).join(leaves, names)
    plan = plan.withColumn("epochs", F.expr("budget div greatest(tokens, 1)"))
    plan = plan.withColumn("rest", F.when(F.col("budget") >= max_epochs * F.col("tokens"), F.lit(-1)).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens")))
    plan = plan.select(*names, F.when(F.col("rest") < 0, F.lit(max_epochs)).otherwise(F.col("epochs")).cast("bigint").alias("epochs"), "rest")
    keyed = slim.join(small(plan), names)
    order_key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn("key", order_key).withColumn("range", F.substring("key", 1, DIGITS))
    ranges = keyed.groupBy(*names, "range", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*names).orderBy("range"))  # at most 16 ** DIGITS rows a leaf
    ends = ranges.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    ends = ends.filter("before <= rest and rest < upto").select(*names, F.col("range").alias("last_range"), F.col("rest") - F.col("before"))
    ends = ends.toDF(*names, "last_range", "left_over")
    last = keyed.join(small(ends), names, "left")
    past = F.when(F.col("last_range").isNull(), F.col("rest") >= 0).otherwise(F.col("range") < F.col("last_range"))
    whole = last.filter(F.col("last_range").isNull() | (F.col("range") != F.col("last_range"))).withColumn("copies", F.col("epochs") + past.cast("bigint"))
    run = F.sum("n_tokens").over(Window.partitionBy(*names, "last_range").orderBy("key", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    cut = last.filter(F.col("range") == F.col("last_range")).withColumn("copies", F.col("epochs") + (run <= F.col("left_over")).cast("bigint"))
    return whole.unionByName(cut).select("doc_id", *names, "n_tokens", "text_hash", "copies")


#: The tree of the driver's documents: a domain is the last digit of the source's name, modulo 3.
DOMAIN = "coalesce(cast(try_cast(right(source, 1) as int) % 3 as string), 'other')"
WEIGHTS = {"domain": {"0": 5, "1": 3, "2": 2}, "lang": {"en": 6, "de": 2, "fr": 2}}
#: Of the query: 60 % of all tokens, from two epochs at most.
NUMERATOR, DENOMINATOR, MAX_EPOCHS = 60, 100, 2


def tree() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, tree(), WEIGHTS, NUMERATOR, DENOMINATOR, MAX_EPOCHS).drop("text_hash")


def mixed_documents(docs: DataFrame, numerator: int, denominator: int = 100, max_epochs: int = 1) -> DataFrame:
    """The documents of the mix, all columns, each as often as the mix holds it."""
    got = mix(docs, tree(), WEIGHTS, numerator, denominator, max_epochs).filter("copies > 0").groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"))
    if max_epochs == 1:
        return same_text(docs, got, "left_semi")
    out, copies = same_text(docs, got, "inner", "copies"), free_name(docs, "copies")
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)


def _sql() -> str:
    weight = lambda c: "case " + c + " " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[c].items()) + " else 1 end" if c in WEIGHTS else "1"

    def level(up: str, node: str) -> str:
        by = f"partition by {up}" if up else ""
        keys = f"{up}, {node}" if up else node
        order = f"{by} order by lim::double / weight, {node} rows between unbounded preceding and 1 preceding"
        parent = f"join at_{up.rpartition(', ')[2]} using ({up})" if up else "cross join root"
        return f"""in_{node} as (select {keys}, lim, weight, got as budget from (select {keys}, sum(tokens)::bigint * {MAX_EPOCHS} as lim, {weight(node)} as weight from leaf group by {keys}) {parent}),
      run_{node} as (select *, coalesce(sum(lim) over ({order}), 0)::bigint as c, coalesce(sum(weight) over ({order}), 0)::bigint as w, sum(weight) over ({by})::bigint as every from in_{node}),
      full_{node} as (select *, (budget - c) * weight >= lim * (every - w) as filled from run_{node}),
      at_{node} as (select {keys}, case when filled then lim else ((budget - coalesce(sum(lim) filter (filled) over ({by}), 0)::bigint) * weight
        // greatest(every - coalesce(sum(weight) filter (filled) over ({by}), 0)::bigint, 1))::bigint end as got from full_{node})"""

    return f"""with d as (select doc_id, coalesce(cast(try_cast(right(source, 1) as int) % 3 as varchar), 'other') as domain, coalesce(lang, '') as lang,
        coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
      leaf as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
      root as (select coalesce(sum(tokens), 0)::bigint * {NUMERATOR} // {DENOMINATOR} as got from leaf),
      {level('', 'domain')}, {level('domain', 'lang')}, {level('domain, lang', 'source')},
      plan as (select domain, lang, source, case when got >= {MAX_EPOCHS} * tokens then {MAX_EPOCHS} else got // greatest(tokens, 1) end as epochs,
        case when got >= {MAX_EPOCHS} * tokens then -1 else got - (got // greatest(tokens, 1)) * tokens end as rest from leaf join at_source using (domain, lang, source)),
      o as (select d.*, epochs, rest, sum(n_tokens) over (partition by domain, lang, source order by md5('mix:' || epochs || ':' || doc_id), n_tokens rows unbounded preceding) as upto
        from d join plan using (domain, lang, source))
      select doc_id, domain, lang, source, n_tokens, (epochs + case when upto <= rest then 1 else 0 end)::bigint as copies from o"""


SQL = _sql()
