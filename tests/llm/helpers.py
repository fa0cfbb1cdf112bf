"""Small tables for the operators' tests."""

from __future__ import annotations

import random

WORDS = "the of and red green blue stone river cloud paper wind light house tree road night day music water fire".split()

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "er", str(r.randrange(1000))]) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text) or whole rows; an extra column with a clashing name comes along."""
    full = [(*r, "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) if len(r) == 2 else r for r in rows]
    from pyspark.sql import functions as F

    return spark.createDataFrame(full, SCHEMA).withColumns({"count": F.lit(1), "component_id": F.lit("x"), "n": F.lit(2), "key": F.lit(3)})


def mixed_rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows."""
    base = [prose(i, 80) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + " end"), (22, base[1].replace("the", "The")), (23, None), (24, ""), (25, "  \n\t "), (26, "one"), (27, "one two"), (28, prose(99, 6000)), (None, base[2]), (3, base[3]), (3, base[3])]
    return rows


def table(df, key="doc_id"):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=str)
