"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.llm.bpe import bpe_decode, bpe_encode
from seekwell.llm.centroids import centroid_clusters
from seekwell.llm.common import documents, fresh_folder, written
from seekwell.llm.exact_dedup import exact_copies
from seekwell.llm.importance import resample
from seekwell.llm.library_ids import encode_ids
from seekwell.llm.main_text import main_text
from seekwell.llm.packing import cut_pieces, pack
from seekwell.llm.quality import fit, fold, quality
from seekwell.llm.simhash import near_components, simhash
from seekwell.llm.sketch import fingerprints, sketch_digits
from seekwell.llm.suffix_dedup import remove_repeats
from seekwell.llm.token_counts import count_tokens
from seekwell.llm.token_files import read_token_files, write_token_files
from seekwell.llm.warc import read_warc, write_warc
from seekwell.sources import read_table, spread

CONTEXT = 4096
REPEAT = 100
END_ID = 1
KEEP_SCORE = 0.3


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > CONTEXT).alias("over_limit"),
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(documents(spark, folder), REPEAT)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_decode(bpe_encode(documents(spark, folder).select("doc_id", "text"), tokenizer), tokenizer)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    prints = written(simhash(documents(spark, folder)).select("doc_id", "fingerprint"), "prints")
    return near_components(prints).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = cut_pieces(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), CONTEXT, END_ID)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    placed = pack(pieces, CONTEXT)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_folder(spark, "tokens")
    encode = partial(encode_ids, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)
    files = write_token_files(documents(spark, folder), root, width=2, ids=encode)
    read = read_token_files(files, root)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(documents(spark, folder))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, quality int, toxic int").parquet(f"{folder}/labels.parquet")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    scored = quality(docs, fit(docs, labels(spark, folder)))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.schema("page_id long, url string, html string").parquet(f"{folder}/pages.parquet")
    root = fresh_folder(spark, "warc")
    records = read_warc(write_warc(pages, root), root)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints(documents(spark, folder))
    digits = {c: sketch_digits(F.col(c)) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns({"edited_sha256": F.sha2("edited_text", 256), **digits}).drop("edited_text")


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.schema("page_id long, url string, html string").parquet(f"{folder}/pages.parquet")
    return main_text(pages)


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return centroid_clusters(spread(vectors, "vec_id"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample(documents(spark, folder), read_table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_suffix_dedup, op3_bpe_roundtrip, op4_simhash_components, op5_best_fit_packing, op6_token_files, op7_exact_dedup, op8_quality_classifier, op9_warc, op10_fingerprints, op11_html_extraction, op12_centroid_clusters, op13_importance_resampling)
}
