"""Quality rules whose cutoffs come from the data: mergeable quantile sketches per language and source.

Fixed base rules catch texts that are wrong anywhere (too few words, mostly
repeats). The other cutoffs are fences: the quartiles of each measure are read
from a sketch of the language and source, and a text is rejected when it lies
more than ``spread`` interquartile ranges (and at least ``slack``) outside.

The sketch is a log-linear histogram: a value keeps its six leading bits, so a
bucket's width is a 32nd of its value at most. Buckets are plain counts; they add
up across partitions, sources and languages. A group of fewer than ``least`` rows
takes its language's fences, or else those of all rows.

Only DataFrame functions are used. A null text has no words; a null language or
source counts as the empty string. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import same_text, saved, small, text_hash

SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: measure: (spread in interquartile ranges, slack, also a lower fence)
FENCES = {"symbols": (3, 150, False), "shouts": (3, 800, False), "dup_lines": (3, 600, False), "repeats": (3, 3500, False), "word_length": (3, 200, True)}
LEAST = 200
#: Of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda x: x != "")


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more."""

    def covered(windows: Column) -> Column:
        """Sorted by hash, equal windows are neighbours."""
        ordered = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("i")))
        twice = let(ordered, lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, counted))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the text, and the counts that the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select("doc_id", key("lang").alias("lang"), key("source").alias("source"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    out = base.select(
        "doc_id",
        "lang",
        "source",
        text_hash(F.col("text")).alias("text_hash"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z!]+", "")).cast("bigint").alias("n_shouts"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    share = lambda a, b, k: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return out.select(
        "*",
        failed.alias("base_failed"),
        share("n_symbols", "word_chars", 10000).alias("symbols"),
        share("n_shouts", "word_chars", 10000).alias("shouts"),
        share("n_dup_lines", "n_words", 10000).alias("dup_lines"),
        share("n_repeat_words", "n_words", 10000).alias("repeats"),
        share("word_chars", "n_words", 100).alias("word_length"),
    )


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: counts that merge by addition."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in FENCES]))
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", values.alias("v")).select("lang", "source", "v.*")
    shift = "cast(greatest(0, length(bin(value)) - 6) as int)"
    rows = rows.withColumn("bucket", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})"))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n, low, high from the merged sketches of a level."""
    merged = sketched.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    quartiles = run.groupBy(*keys, "measure").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))
    choose = lambda i: F.coalesce(*[F.when(F.col("measure") == m, F.lit(v[i])) for m, v in FENCES.items()])
    width = F.greatest(choose(0) * (F.col("q3") - F.col("q1")), choose(1))
    return quartiles.select(*keys, "measure", "n", F.when(choose(2), F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def thresholds(sketched: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per language and source: an array of the fences of each measure."""
    own, lang, every = (fences(sketched, k) for k in (["lang", "source"], ["lang"], []))
    lang = lang.select("lang", "measure", F.struct("n", "low", "high").alias("by_lang"))
    every = every.select("measure", F.struct("n", "low", "high").alias("by_all"))
    joined = own.join(lang, ["lang", "measure"]).join(every, "measure")
    chosen = F.when(F.col("n") >= least, F.struct("n", "low", "high")).when(F.col("by_lang.n") >= least, F.col("by_lang")).otherwise(F.col("by_all"))
    joined = joined.select("lang", "source", "measure", chosen.alias("c"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(f"c.{side}"))).alias(f"{m}_{side}")
    return joined.groupBy("lang", "source").agg(*[pick(m, side) for m, v in FENCES.items() for side in (("low", "high") if v[2] else ("high",))])


def judge(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The measures of every document with `kept`: it passes the base rules and lies inside its group's fences."""
    measured = saved(measure(docs))
    limits = small(thresholds(sketch(measured), least))
    outside = F.lit(False)
    for m, (_, _, both) in FENCES.items():
        outside |= F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
        if both:
            outside |= F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
    return measured.join(limits, ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & ~outside)


def kept_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that the rules keep, all columns."""
    return same_text(docs, judge(docs, least).filter("kept"), "left_semi")


def _sql() -> str:
    shift = "greatest(0, length(bin(value)) - 6)"
    spread = lambda i: "case measure " + " ".join(f"when '{m}' then {str(v[i]).lower()}" for m, v in FENCES.items()) + " end"
    level = lambda name, keys: f"""{name} as (select {keys} measure, max(total) as n, min(bucket) filter (4 * upto >= total) as q1, min(bucket) filter (4 * upto >= 3 * total) as q3
      from (select *, sum(n) over (partition by {keys} measure order by bucket) as upto, sum(n) over (partition by {keys} measure) as total
        from (select {keys} measure, bucket, sum(n) as n from sketch group by {keys} measure, bucket)) group by {keys} measure)"""  # noqa: E731
    outside = " or ".join(f"(measure = '{m}' and (value > high" + (" or value < low" if v[2] else "") + "))" for m, v in FENCES.items())
    return f"""with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
      ln as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
        where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
      tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
      twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as n from tri) where n > 1),
      rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
      m as (select d.doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, length(regexp_replace(text, '[^A-Z!]+', '', 'g')) as n_shouts,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
        from d left join ln using (doc_id) left join rep using (doc_id)),
      f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m),
      v as (select doc_id, lang, source, base_failed, unnest(['symbols', 'shouts', 'dup_lines', 'repeats', 'word_length']) as measure,
        unnest([10000 * n_symbols // greatest(word_chars, 1), 10000 * n_shouts // greatest(word_chars, 1), 10000 * n_dup_lines // greatest(n_words, 1),
          10000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)]) as value from f),
      sketch as (select lang, source, measure, ((value >> {shift}) << {shift}) as bucket, count(*) as n from v where not base_failed group by all),
      {level('own', 'lang, source,')}, {level('by_lang', 'lang,')}, {level('by_all', '')},
      chosen as (select o.lang, o.source, measure, case when o.n >= {LEAST} then o.q1 when l.n >= {LEAST} then l.q1 else a.q1 end as q1,
        case when o.n >= {LEAST} then o.q3 when l.n >= {LEAST} then l.q3 else a.q3 end as q3
        from own o join by_lang l using (lang, measure) join by_all a using (measure)),
      fence as (select lang, source, measure, case when {spread(2)} then q1 - greatest({spread(0)} * (q3 - q1), {spread(1)}) end as low,
        q3 + greatest({spread(0)} * (q3 - q1), {spread(1)}) as high from chosen),
      bad as (select doc_id, bool_or({outside}) as outside from v join fence using (lang, source, measure) group by doc_id)
      select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(outside, false) as kept
      from f left join bad using (doc_id)"""


SQL = _sql()
