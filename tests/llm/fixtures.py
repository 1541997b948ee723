"""Small documents with every odd case: nulls, empty and very long texts, ties, repeated rows."""

from __future__ import annotations

import random

WORDS = "river stone cloud paper light green table music garden winter summer bridge candle forest mirror planet silver thunder velvet window".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))


def odd_documents() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "altered"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (7, "one two"), (8, prose(2, 40_000)),
        (None, base), (9, "ONE  Two"), (10, prose(3, 200)), (11, "\x00 null byte"), (12, "ünïcode wörds çà"), (13, base.upper()),
    ]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    """Columns named like those that operators make inside."""
    from pyspark.sql import functions as F

    for name in ("rk", "fp", "score", "key", "leaf", "tokens", "row", "component", "root", "head"):
        df = df.withColumn(name, F.lit("x"))
    return df
