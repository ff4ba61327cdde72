"""Token counts, BPE, token files and packing against the libraries themselves."""

import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import TEXTS, clashing, frame, fuzz, long_text, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seekwell.llm import library_ids
from seekwell.llm.bpe import Units, Vocabulary, bpe_decode, bpe_encode
from seekwell.llm.common import file_bytes
from seekwell.llm.library_ids import Words, encode_ids
from seekwell.llm.packing import cut_pieces, pack, plan, sequences
from seekwell.llm.token_counts import count_tokens
from seekwell.llm.token_files import EliasFano, elias_fano, read_token_files, write_token_files

PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ALL = TEXTS + fuzz(1, 150) + [long_text()]


def library(path):
    return partial(Tokenizer.from_file(path).encode, add_special_tokens=False)


def test_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = count_tokens(clashing(frame(spark, rows(ALL)), "n_tokens", "count"), PIECE)
    assert got.columns == ["doc_id", "text", "n_tokens", "count"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(model.encode(t or "")) for i, t in rows(ALL)}
    assert count_tokens(frame(spark, []), PIECE).count() == 0


def test_bpe_equals_library(spark):
    encode, decode = library(BYTE), Tokenizer.from_file(BYTE).decode
    coded = bpe_decode(bpe_encode(clashing(frame(spark, rows(ALL)), "ids", "decoded"), BYTE), BYTE)
    for r in coded.collect():
        want = encode(ALL[r.doc_id] or "").ids
        assert r.ids == want
        assert r.decoded == decode(want, skip_special_tokens=False)
    assert bpe_decode(bpe_encode(frame(spark, []), BYTE), BYTE).count() == 0


def test_decode_of_torn_and_unknown_ids(spark):
    ids = Tokenizer.from_file(BYTE).encode("😀", add_special_tokens=False).ids
    data = [(1, ids[:1]), (2, [-5, 10**6, None]), (3, None), (4, [])]
    got = {r.k: r.decoded for r in bpe_decode(frame(spark, data, "k int, ids array<int>"), BYTE).collect()}
    assert got[1] == Tokenizer.from_file(BYTE).decode(ids[:1], skip_special_tokens=False)
    assert got[2] == got[3] == got[4] == ""


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(file_bytes(BYTE))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeiînst ghé'1!😀"), min_size=1, max_size=40))
def test_prefix_programming_is_bpe(vocabulary, word):
    assert np.frombuffer(Units(vocabulary).encode(word), np.int32).tolist() == library(BYTE)(word).ids


def test_every_token_encodes_to_itself(vocabulary):
    assert len(vocabulary.matches) == 50256


def test_word_ids_equal_library(spark):
    encode = library(WORD)
    got = encode_ids(clashing(frame(spark, rows(ALL)), "ids"), WORD, end_id=1).collect()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == encode(ALL[r.doc_id] or "").ids + [1]


@pytest.fixture(scope="module")
def words():
    return Words(file_bytes(WORD)), library(WORD)


ODD = st.text(alphabet=st.sampled_from("abSTsted ABéÉŷİıß×ªµ'.,!<|>_-1²\u0301\u0331\u0307\u200b\xa0\x85\x1c\n\t漢Σσ"), max_size=25)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_word_ids_of_odd_words(words, texts):
    got = words[0].of_texts(pa.array(texts, pa.string()), b"\1\0\0\0")
    assert [np.frombuffer(ids.as_py(), "<u4").tolist() for ids in got] == [words[1](t).ids + [1] for t in texts]


def test_a_word_is_encoded_once_whatever_ends_it(monkeypatch):
    """Copies, capitals and punctuation at a word's end cost the library nothing, also when words have filled the cache in between."""
    monkeypatch.setattr(library_ids, "CACHE_WORDS", 300)
    asked, encode = [], library(WORD)
    fresh = Words(file_bytes(WORD))
    fresh.direct = lambda letters: asked.append(letters) or Words.direct(fresh, letters)
    texts = [f"zebra Zebra, ZEBRA%%% zebra.### {' '.join(f'w{chr(97 + i)}{chr(97 + j)}x' for j in range(26))} zebra" for i in range(26)]
    for text in texts:
        got = fresh.of_texts(pa.array([text, "", " \n"]), b"")
        assert [np.frombuffer(ids.as_py(), "<u4").tolist() for ids in got] == [encode(text).ids, [], []]
    assert asked.count("zebra") == 1 and len(asked) == 26 * 26 + 1
    assert len(fresh.of_texts(pa.array([], pa.string()), b"")) == 0


def test_word_ids_by_slices(spark, monkeypatch):
    encode = library(WORD)
    monkeypatch.setattr(library_ids, "BATCH_BYTES", 50)
    texts = pa.array(ALL[:60], pa.string())
    parts = list(library_ids._batches(texts))
    assert len(parts) > 5 and pa.concat_arrays(parts) == texts
    assert [len(p) for p in library_ids._batches(texts[:0])] == [0]
    none = encode_ids(frame(spark, [(1, None), (2, "")]), WORD).collect()
    assert [bytes(r.ids) for r in none] == [b"", b""] and encode("").ids == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 10**12))
def test_elias_fano(gaps, first):
    values = np.cumsum([first, *gaps]) if gaps else np.zeros(0, np.int64)
    code = EliasFano(elias_fano(values))
    for start, stop in [(0, len(values)), (len(values) // 3, len(values) // 2), (len(values) - 1, len(values)), (300, 5)]:
        start, stop = max(0, min(start, len(values))), min(stop, len(values))
        assert code.between(start, stop).tolist() == values[start:stop].tolist()
    assert [code[i] for i in range(len(code))] == values.tolist()
    with pytest.raises(IndexError):
        code[len(values)]


@pytest.mark.parametrize(("ids", "docs"), [(1 << 20, 1 << 14), (50, 1 << 14), (1 << 20, 3), (1, 1)])
def test_blocks_of_a_file(spark, tmp_path, monkeypatch, ids, docs):
    """Whatever the blocks, documents are the same: empty ones, some without an id, one longer than a block."""
    from seekwell.llm import token_files

    rows = [(None, [1, 2]), (None, []), *((10 * i, list(range(i % 7))) for i in range(40)), (1000, list(range(300)))]
    data = [(d, np.array(v, "<u4").tobytes()) for d, v in rows]
    frame_of = spark.createDataFrame([(d, bytearray(b)) for d, b in data], "doc_id long, ids binary").coalesce(1)
    files = write_token_files(frame_of, str(tmp_path))
    monkeypatch.setattr(token_files, "READ_IDS", ids)
    monkeypatch.setattr(token_files, "READ_DOCS", docs)
    got = [(d, bytes(b)) for f in files.collect() for d, b in read_plainly(token_files, f.path)]
    assert sorted(got, key=repr) == sorted(data, key=repr)


def read_plainly(module, path):
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(path) as f:
        for batch in module._documents(f, 0):
            assert (np.diff(batch.column(1).to_numpy()) == batch.column(2).to_numpy()[:-1]).all()
            yield from zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())


def test_token_files(spark, tmp_path):
    encode = library(WORD)
    data = [(7 * i % 501 - 100, t) for i, t in enumerate(ALL)] + [(None, "no id"), (3, "again"), (3, "again")]
    files = write_token_files(frame(spark, data), str(tmp_path), 2, ids=partial(encode_ids, tokenizer=WORD, end_id=1))
    got = read_token_files(files, str(tmp_path)).orderBy("start").collect()
    assert len(got) == len(data)
    assert [r.doc_id for r in got] == sorted((d for d, _ in data), key=lambda d: (d is not None, d or 0))
    want = defaultdict(list)
    for d, t in data:
        want[d].append(encode(t or "").ids + [1])
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens) == (at, len(ids))
        want[r.doc_id].remove(ids)
        at += len(ids)
    path = files.first().path
    with open(path, "r+b") as f:
        f.seek(9)
        f.write(b"\xff\xff\xff\xff")
    with pytest.raises(Exception, match="damaged"):
        read_token_files(files, str(tmp_path)).collect()


def test_token_files_of_no_documents_and_of_wide_ids(spark, tmp_path):
    empty = frame(spark, [], "doc_id long, ids binary")
    files = write_token_files(empty, str(tmp_path / "a"))
    assert read_token_files(files, str(tmp_path / "a")).count() == 0
    wide = frame(spark, [(1, np.array([70000], "<u4").tobytes())], "doc_id long, ids binary")
    assert read_token_files(write_token_files(wide, str(tmp_path / "b")), str(tmp_path / "b")).first().ids == wide.first().ids
    with pytest.raises(Exception, match="two bytes"):
        write_token_files(wide, str(tmp_path / "c"), width=2)


def check_places(got, capacity):
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for items in at.values():
        items.sort()
        assert items[0][0] == 0 and sum(items[-1]) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:]))
    return len(at)


def test_pieces_and_sequences(spark):
    encode, data = library(WORD), rows(ALL) + [(500, None), (None, "no id"), (6, TEXTS[6])]
    pieces = cut_pieces(frame(spark, data), WORD, 64, 1).cache()
    placed = pack(clashing(pieces, "sequence_id", "offset", "base", "lane", "size", "item"), 64).cache()
    got = placed.collect()
    want = [(d, encode(t or "").ids + [1]) for d, t in data]
    assert sorted((r.doc_id or -1, r.start, r.length, zlib.crc32(r.ids)) for r in got) == sorted(
        (d or -1, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()))
        for d, ids in want
        for s in range(0, len(ids), 64)
    )
    n = check_places(got, 64)
    assert n <= 1.02 * (sum(len(i) for _, i in want) / 64) + 1
    full = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(placed).collect()}
    for r in got:
        assert full[r.sequence_id][r.offset : r.offset + r.length].tobytes() == r.ids


def test_pack_edges(spark):
    none = frame(spark, [], "doc_id long, piece int, length long")
    assert pack(none, 8).count() == 0
    for bad in (0, 9, None):
        with pytest.raises(Exception, match="length out of range"):
            pack(frame(spark, [(1, 0, bad)], "doc_id long, piece int, length long"), 8).collect()
    same = frame(spark, [(1, 0, 3)] * 1000, "doc_id long, piece int, length long")
    assert check_places(pack(same, 8).collect(), 8) == 500


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan(counts):
    capacity, table = 60, plan(counts, 60)
    keys, used = table[:, 0] << 44 | table[:, 1], defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            assert row[0] == length
            nth = rank - row[1]
            used[int(row[3] + nth // row[2])].append((int(row[4] + nth % row[2] * length), length))
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and sum(items[-1]) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:]))
    # never more than first fit decreasing would promise
    assert len(used) <= 11 / 9 * -(-sum(k * n for k, n in counts.items()) // capacity) * 1.6 + 2
