"""The plans are the ones meant, and the entry points run from anywhere."""

import contextlib
import io
import os
import subprocess
import sys

import pytest

from seekwell.operators import bm25_topk, chunk_documents, context_pack, postings
from seekwell.plans.catalog import QUERIES
from seekwell.sources import read_table, spread, stream_table

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def asked(spark):
    return read_table(spark, FOLDER, "benchmark").withColumnRenamed("item_id", "query")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_the_needed_columns_are_read(docs, asked):
    for df in (chunk_documents(docs), postings(docs), bm25_topk(asked, docs), context_pack(asked, docs)):
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(df)


def test_chunks_and_postings_need_no_shuffle_and_tokenize_once(docs):
    for df, tokenizer in ((chunk_documents(docs), r"\s+"), (postings(docs), r"[^\p{L}\p{N}]+")):
        text = plan(df)
        assert "Exchange" not in text
        project = [line for line in text.splitlines() if tokenizer in line and line.startswith("Output")]
        assert len(project) == 1 and project[0].count(tokenizer) == 1, project


def test_ranking_shuffles_only_what_the_tasks_kept(docs, asked):
    lines = [line for line in plan(bm25_topk(asked, docs)).splitlines() if "(" in line]
    tree = lines[: next(i for i, line in enumerate(lines) if "Scan parquet" in line) + 1]
    scan_side = tree[next(i for i, line in enumerate(tree) if "MapInArrow" in line) :]
    assert not any("Exchange" in line for line in scan_side)


def test_spread_leaves_a_table_of_enough_files_alone(spark, docs, tmp_path):
    assert "Exchange" in plan(spread(docs, "doc_id"))
    docs.repartition(4, "doc_id").write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert "Exchange" not in plan(spread(many, "doc_id"))


def test_stream_reads_just_the_table_of_its_name(spark, docs, tmp_path):
    docs.limit(3).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(50).coalesce(1).write.parquet(str(tmp_path / "documents_old.parquet"))
    query = stream_table(spark, str(tmp_path), "documents").writeStream.format("memory").queryName("just").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("just").count() == 3


def test_tasks_run_where_the_package_is_not_installed(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from __spark_entry__ import entry, queries
print("rows", entry(spark).count(), queries()["knn_lsh"](spark, {FOLDER!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 160 5000" in done.stdout, done.stderr[-2000:]
