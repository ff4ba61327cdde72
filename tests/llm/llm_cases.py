"""Small inputs that every operator has to take: nulls, empty and long texts, ties, copies, clashing column names."""

import random

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "The quick brown fox jumps over the lazy dog. " * 4,
    "The quick brown fox jumps over the lazy dog. " * 4,
    "the  quick brown fox jumps over\tthe lazy dog.\n" * 4,
    "Ünïcödé — ελληνικά 漢字 😀😀 Straße İstanbul ſ ﬁ\x85x\xa0y​z",
    "tail space  ",
    " lead",
    "<|endoftext|> a<|startoftext|>b <s> </s> <unk> ▁▁a",
    "a" * 700,
    "ab " * 500,
    "line\r\nline\r\n\r\nline\x0b\x0c\x1c\x1f end",
    "I'll don't WE'VE 12345 3.14 !!! $$$ x_y",
]


def fuzz(seed: int, n: int) -> list[str]:
    """Texts of odd pieces, some with long shared passages."""
    rng = random.Random(seed)
    pieces = [" ", "  ", "\n", "\t", "é", "a", "b", "the", " of", "ing", ",", ".", "!", "1", "23", "😀", "ß", "Ñ", "'s", "́", "漢"]
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(90, 260))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.2 else rng.choice(pieces) for _ in range(rng.randint(0, 25))]
        out.append("".join(parts))
    return out


def long_text(seed: int = 5, words: int = 60_000) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(words))


def rows(texts: list[str | None], start: int = 0) -> list[tuple[int, str | None]]:
    return list(enumerate(texts, start))


def frame(spark, data, columns="doc_id long, text string"):
    return spark.createDataFrame(data, columns)


def clashing(df, *names):
    """The frame with columns that are named like those an operator makes or uses."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"own {n}") for n in names if n not in df.columns})
