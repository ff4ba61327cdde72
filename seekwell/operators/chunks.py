"""Documents to overlapping passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.functions import windows


def chunk_documents(documents: DataFrame, width: int = 64, stride: int = 48) -> DataFrame:
    """doc_id, chunk, n_words, text: one narrow step per document, no shuffle."""
    return (
        documents.select("doc_id", windows(F.col("text"), width, stride).alias("w"))
        # outer, because the plain form would cut the windows once more to test for empty arrays
        .select("doc_id", F.inline_outer("w"))
        .where(F.col("chunk").isNotNull())
    )
