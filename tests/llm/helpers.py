from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 60)) for _ in range(n))


def docs(spark, texts: dict[int, str | None] | list[tuple], sources: int = 3):
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    rows = [(i, t, "en", f"s{(i or 0) % sources}", len(t or "")) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "score spans label key h1 h2 pos seg rank bucket node component signatures n size takes block v dim group bin part start end predicted".split()
    return df.withColumns({n: F.lit(1) for n in names})
