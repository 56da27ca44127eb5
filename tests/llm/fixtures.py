"""Awkward documents: nulls, empties, ties, repeats, a very long text, clashing column names."""

DOCS = [
    (0, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "... 123 !!", "en", "c"),
    (6, "word", "en", None),
    (7, "le chat noir dort sur la table pendant que le chien mange dans la cuisine avec les enfants", "fr", "c"),
    (7, "le chat noir dort sur la table pendant que le chien mange dans la cuisine avec les enfants", "fr", "c"),
    (8, " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000)), "en", "a"),
    (9, "une phrase avec des \U0001d54f caractères étranges\tet des\nlignes", "fr", "b"),
    (None, "a text without an id but with words", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, extra=True):
    df = spark.createDataFrame(DOCS, SCHEMA)
    if extra:  # names that operators use inside
        for name in ("set_id", "size", "text_hash", "found", "label", "n_hit", "score", "shard", "__x"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)
