"""Small corpora with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(words))


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    edited = base.split(" ")
    edited[60] = "changed"
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (2, base, "en", "s", 1), (3, "  " + base + "\n", "en", "s", 1),
        (4, " ".join(edited), "en", "s", 1), (5, "", "en", "s", 0), (6, None, None, None, None), (None, base, "en", "s", 1),
        (None, None, None, None, None), (7, sentence(rng, 20_000), "en", "s", 9), (8, "x" * 50_000, "en", "s", 9),
        (9, "one", "en", "s", 1), (10, "one two three", "en", "s", 1), (11, "\n \t", "en", "s", 1),
        (12, "Straße ünïcode 日本語 🙂 \x85　end", "de", None, 1), (-5, "negative id " + sentence(rng, 30), "fr", "s", 1),
    ]
    return rows + [(100 + i, sentence(rng, rng.randint(5, 60)), "en", f"s{i % 3}", 1) for i in range(20)]


def with_clashes(df):
    """Extra columns named as the operators' own results and helpers, in other cases too."""
    from pyspark.sql import functions as F

    names = [
        "kept", "keep_id", "group_size", "digest", "row", "size", "key", "flag", "found", "blob", "class", "Component", "quality", "predicted",
        "score", "ids", "part", "start", "_text", "_id", "block", "bits", "n_tokens", "node", "label_",
    ]
    return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in names])
