"""Column expressions on text. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a variable.

    A plain reference would be substituted into every lambda of `body` by the
    optimizer, so that a tokenizer runs again for each array position.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(text: Column) -> Column:
    """Lower case, every run of non-letters and non-digits as one space, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " ")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(norm(text), " "), "")


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf, doc_len>> of a token array, counted inside the row.

    Sort, mark where each run of equal tokens starts, and subtract the starts:
    n log n in the row, and no shuffle to group what already lies together.
    """

    def runs(s: Column) -> Column:
        starts = F.array_compact(
            F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i - 1)), i))
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).cast("long").alias("tf"),
                    F.size(s).cast("long").alias("doc_len"),
                ),
            ),
        )

    return bind(F.sort_array(tokens), runs)


def windows(text: Column, width: int, stride: int) -> Column:
    """array<struct<chunk, n_words, text>>: overlapping windows of `width` words.

    Windows start every `stride` words; the last is the first that reaches the
    end of the text. Null for a text with no words.
    """
    if not 0 < stride <= width:
        raise ValueError("need 0 < stride <= width, or words would be lost between windows")

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        last = F.greatest(F.lit(0), F.ceil((n - width) / stride)).cast("int")

        def window(i: Column) -> Column:
            return bind(
                F.slice(ws, i * stride + 1, width),
                lambda part: F.struct(
                    i.cast("long").alias("chunk"),
                    F.size(part).cast("long").alias("n_words"),
                    F.array_join(part, " ").alias("text"),
                ),
            )

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window))

    return bind(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""), cut)
