"""Small corpora for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def frame(spark, texts, ids=None, sources=None):
    rows = []
    for k, t in enumerate(texts):
        i = k if ids is None else ids[k]
        rows.append((i, t, "en", "s" if sources is None else sources[k], None if t is None else len(t)))
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same table with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("size", "target", "copies", "kept", "score", "node", "key", "hits", "shard", "slot", "spans", "s", "n", "rate", "draw", "of", "text_crc32", "base_failed", "component", "gone")
    return df.withColumns({c: F.lit(1) for c in names})


def opposite_words(power: int = 10) -> tuple[str, str]:
    """Two words of 2**power letters, the second with a and b exchanged: every polynomial modulo 2**64 confuses them."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << power))
    return a, a.translate(str.maketrans("ab", "ba"))
