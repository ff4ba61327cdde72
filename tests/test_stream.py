import shutil
import uuid

from pyspark.sql import functions as F

from seekwell.operators import bm25_topk, dictionary, inverted_index, rank_index
from seekwell.session import shared_dir
from seekwell.sources import read_table, stream_table
from seekwell.streaming import compact_index, read_dictionary, read_index, start_index
from seekwell.streaming.index import write_batch

FOLDER = "/root/testdata/sf0.001"


def add(docs, tmp_path, name):
    """One more file of the stream's table."""
    docs.coalesce(1).write.parquet(str(tmp_path / name))
    folder = tmp_path / "in" / "documents.parquet"
    folder.mkdir(parents=True, exist_ok=True)
    for f in (tmp_path / name).glob("*.parquet"):
        shutil.copy(f, folder / f"{name}.parquet")


def rows(df):
    return sorted(tuple(r) for r in df.select("term", "doc_id", "tf", "df", "doc_len").collect())


def test_a_folder_of_part_files_is_a_stream_too(spark, tmp_path):
    documents = read_table(spark, FOLDER, "documents")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    root = f"{shared_dir(spark)}/index-{uuid.uuid4()}"
    start_index(stream_table(spark, str(tmp_path), "documents", 2), root).awaitTermination()
    assert rows(read_index(spark, root)) == rows(inverted_index(documents))


def test_batches_and_restart_equal_one_batch(spark, tmp_path):
    documents = read_table(spark, FOLDER, "documents")
    root = f"{shared_dir(spark)}/index-{uuid.uuid4()}"

    def arrive(part, name):
        add(documents.where(F.pmod("doc_id", F.lit(3)) == part), tmp_path, name)

    def index():
        start_index(stream_table(spark, str(tmp_path / "in"), "documents", 1), root).awaitTermination()

    arrive(0, "a")
    arrive(1, "b")
    index()
    assert 0 < read_index(spark, root).select("doc_id").distinct().count() < documents.count()
    arrive(2, "c")
    index()
    want = rows(inverted_index(documents))
    assert rows(read_index(spark, root)) == want

    # the batch that a failure makes Spark run again replaces itself
    again = documents.where(F.pmod("doc_id", F.lit(3)) == 2).select("doc_id", "text")
    write_batch(root)(again, 2)
    assert rows(read_index(spark, root)) == want

    # the stored dictionary serves rankings
    asked = read_table(spark, FOLDER, "benchmark").select(F.col("item_id").alias("query"), "text")
    plain = bm25_topk(asked, documents).collect()
    stored = bm25_topk(asked, documents, stats=read_dictionary(spark, root)).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, stored)) and plain
    index = rank_index(asked, read_index(spark, root), read_dictionary(spark, root)).drop("method").collect()
    assert sorted(map(tuple, index)) == sorted(map(tuple, plain))


def versions(spark, *batches):
    for batch in batches:
        yield spark.createDataFrame([(i, t, "en", "s", 0) for i, t in batch], read_table(spark, FOLDER, "documents").schema)


def terms(df):
    return sorted((r.term, r.df, r.total_len or 0) for r in df.collect())


def test_an_index_of_nothing_is_readable(spark, tmp_path):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4()}"
    add(next(versions(spark, [])), tmp_path, "none")
    start_index(stream_table(spark, str(tmp_path / "in"), "documents"), root).awaitTermination()
    assert read_index(spark, root).count() == 0
    assert all(r.df == 0 for r in read_dictionary(spark, root).collect())
    assert compact_index(spark, root) in (-1, 0)
    assert read_index(spark, root).count() == 0


def test_the_last_version_of_a_document_counts(spark, tmp_path):
    batches = [
        [(1, "old old text"), (2, "stays as it is"), (3, "goes empty"), (None, "no id"), (5, None), (6, "same")],
        [(1, "new text"), (3, ""), (4, "arrives later"), (6, "same"), (6, "same"), (None, "no id")],
        [(1, "third text of one"), (2, "stays as it is"), (7, "the last one")],
        [(4, "edited after all"), (8, "late")],
    ]
    last = {}
    root = f"{shared_dir(spark)}/index-{uuid.uuid4()}"
    for number, batch in enumerate(batches):
        add(next(versions(spark, batch)), tmp_path, f"part{number}")
        start_index(stream_table(spark, str(tmp_path / "in"), "documents", 1), root).awaitTermination()
        if number == 2:  # what comes later is read beside the compacted tables
            before = rows(read_index(spark, root)), terms(read_dictionary(spark, root))
            assert compact_index(spark, root) == 2 and compact_index(spark, root) == 2
            assert (rows(read_index(spark, root)), terms(read_dictionary(spark, root))) == before
        for place, (doc_id, text) in enumerate(batch):
            last[(number, place) if doc_id is None else doc_id] = (doc_id, text)
        whole = spark.createDataFrame(list(last.values()), "doc_id long, text string")
        key = lambda found: sorted(found, key=repr)
        assert key(rows_of(read_index(spark, root))) == key(rows_of(inverted_index(whole)))
        assert terms(read_dictionary(spark, root)) == terms(dictionary(whole))


def rows_of(df):
    return [tuple(r) for r in df.select("term", "doc_id", "tf", "df", "doc_len").collect()]
