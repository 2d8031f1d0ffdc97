"""Small tables with everything that may stand in a column."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rank int, part long, start long"


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, one long text, ties, repeated rows, clashing columns."""
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base, other = prose(80), prose(60)
    texts = [base, base, base.upper(), base + " more words here", other, other + ".", None, "", "   \n\t", "one two", "one  two", "ONE two", "x", "日本語テキスト", "á é <|endoftext|> b", prose(9000), "123 456 !!", "i d i o t you", None, base]
    rows = [(i, t, "en" if i % 3 else None, ["s0", "s0", "s1", None][i % 4], None if t is None else len(t), "clash", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base, "de", "s1", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
