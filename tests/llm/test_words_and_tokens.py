"""Words, tokens, packing and token files against plain versions."""

import io
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logloom.llm import packing, token_files, words
from logloom.llm.tokens import WordTokenizer

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "\n", "a", "The cat\nsat.", "  two  blanks ", "é́ à", "don't 'S", "<|endoftext|> x<|", "\0 \0a", "\x1cx \x85y",
    "日本 🙂\r\nx", "Σς İ", "a" * 5000, "word " * 3000, " x 　y",
]


def test_words_are_those_of_the_pattern():
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for kind, pattern in (
        (words.NOT_BLANK, r"[^\x20\x09-\x0D]+"), (words.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        seen: dict[str, int] = {}
        texts = [*ODD, None, *ODD[:5]]
        hashed = [(lo, h, f) for lo, h, f in words.hashed(pa.array(texts, pa.string()), kind)]
        assert [lo for lo, _, _ in hashed] == [0]
        _, hashes, first = hashed[0]
        for i, text in enumerate(texts):
            expected = re.findall(pattern, (text or "").translate(lower))
            found = hashes[first[i] : first[i + 1]].tolist()
            assert len(found) == len(expected)
            for word, value in zip(expected, found):
                assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_slices_hold_whole_texts():
    offsets = np.array([0, 5, 5, 50, 52, 54])
    assert list(words.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(words.slices(np.zeros(1, np.int64), 10)) == []


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_cached_pieces_give_the_tokenizers_ids(path):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    cached = WordTokenizer(path, cache_words=40)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(ODD[:13] + list(" \n.,'aZé")) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    for i in range(0, len(texts), 20):
        part = texts[i : i + 20]
        for data, e in zip(cached.encode(part), plain.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(data, "<u4").tolist() == e.ids


def test_python_sees_each_distinct_piece_of_a_group_once(monkeypatch):
    plain = Tokenizer.from_file(BYTE_BPE)
    plain.encode_special_tokens = True
    texts = ["the cat, the\u00a0dog.\nThe end " + "the cat " * 500 + "ends", "the cat", "caf\u00e9\x1cbar the.\nx"]
    cached = WordTokenizer(BYTE_BPE)

    def whole_text(text):
        raise AssertionError("a text without unusual white space was cut piece by piece")

    monkeypatch.setattr(WordTokenizer, "pieces", staticmethod(whole_text))
    for data, e in zip(cached.encode(texts), plain.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(data, "<u4").tolist() == e.ids


def test_known_pieces_are_not_looked_for_again(monkeypatch):
    cached = WordTokenizer(BYTE_BPE)
    texts = ["one two three", "two three four five"]
    first = cached.encode(texts)
    asked, unknown = [], WordTokenizer._unknown
    monkeypatch.setattr(WordTokenizer, "_unknown", lambda self, wanted: asked.extend(wanted) or unknown(self, wanted))
    assert cached.encode(texts) == first and not asked


def test_selectors_of_a_block_need_no_sums(monkeypatch):
    def summed(*x, **y):
        raise AssertionError("a sum over the ids for every selector")

    monkeypatch.setattr(np, "cumsum", summed)
    rng = np.random.default_rng(2)
    blocks = []
    for n in (0, 1, 7, 59, 240, 241, 3000):
        bits = rng.integers(0, rng.choice([2, 5, 17, 31, 64]), n).astype(np.uint64)
        ids = (np.uint64(1) << bits) - rng.integers(0, 2, n).astype(np.uint64)
        ids[rng.random(n) < 0.4] = 0
        blocks.append((ids, token_files.encode_block(ids)))
    monkeypatch.undo()
    for ids, block in blocks:
        assert (token_files.decode_block(block) == ids).all()
        words = np.frombuffer(block, "<u8", struct.unpack_from("<4I", block)[1], 16)
        at = 0
        for selector in (words >> np.uint64(60)).tolist():  # each word holds as many ids as any could from there
            fits = [s for s, count, width in token_files.SELECTORS if at + count <= len(ids) and all(int(x) >> width == 0 or int(x) >> 60 for x in ids[at : at + count])]
            assert selector == min(fits)
            at += token_files.SELECTORS[selector][1]
        assert at == len(ids)


def test_fullest_is_the_fullest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= room}
        found = packing.fullest(counts, room)
        assert sum(x * n for x, n in found.items()) == max(sums)
        assert all(n <= counts[x] for x, n in found.items())


def check_packed(rows, capacity):
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_packing(spark):
    texts = [*ODD, None, ODD[4], ODD[4]]
    docs = spark.createDataFrame(
        [(None if i == 3 else i % 17, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, length string"
    )
    pieces = packing.token_pieces(docs, BYTE_BPE, 2, capacity=64)
    found = pieces.collect()
    plain = Tokenizer.from_file(BYTE_BPE)
    plain.encode_special_tokens = True
    expected = sorted(plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts)
    joined: dict = {}
    runs = []
    for r in found:  # pieces of one document follow each other
        if r.piece == 0:
            runs.append([])
        assert r.start == len(runs[-1]) and r.length == len(r.ids) // 4
        assert r.piece == 0 or r.length == 64
        runs[-1] += np.frombuffer(r.ids, "<u4").tolist()
    assert sorted(runs) == expected and joined == {}
    packed = packing.pack(pieces.selectExpr("*", "'a' AS row", "1 AS rank"), 64)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "row", "rank", "sequence_id", "offset"]
    rows = packed.collect()
    assert len(rows) == len(found)
    total = sum(r.length for r in rows)
    assert check_packed(rows, 64) <= -(-total // 64) + 2
    assert packing.pack(pieces.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces, 8)


def test_many_pieces_of_one_length_are_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 50)
    pieces = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "CASE WHEN id % 3 = 0 THEN 700L ELSE id % 300 + 1 END AS length")
    rows = packing.pack(pieces, 1024).collect()
    assert len(rows) == 1000 == len({r.doc_id for r in rows})
    assert check_packed(rows, 1024) == 334  # one sequence for each long piece


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_blocks_round_trip(ids):
    values = np.array(ids, np.uint64)
    data = token_files.encode_block(values)
    assert token_files.decode_block(data).tolist() == ids
    assert len(data) == 16 + 8 * struct.unpack_from("<4I", data)[1] + 16 * struct.unpack_from("<4I", data)[2]


def test_runs_of_small_ids_share_words():
    assert len(token_files.encode_block(np.zeros(480, np.uint64))) == 16 + 2 * 8
    assert len(token_files.encode_block(np.ones(600, np.uint64))) == 16 + 10 * 8


def test_files_round_trip_in_groups():
    out = io.BytesIO()
    writer = token_files.FileWriter(out, block_ids=100)
    docs = [(i if i % 5 else None, np.arange(i * 7 % 230, dtype=np.uint64)) for i in range(60)]
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    found = []
    for names, lengths, ids in token_files.read_file(pa.BufferReader(out.getvalue()), group_ids=300):
        for name, part in zip(names, np.split(ids, np.cumsum(lengths)[:-1])):
            found.append((name, part.tolist()))
    assert found == [(d, x.tolist()) for d, x in docs]
    with pytest.raises(ValueError):
        list(token_files.read_file(pa.BufferReader(out.getvalue()[:-3])))


def test_written_files_read_back_in_order(spark, tmp_path):
    texts = [*ODD, None, ODD[4], ODD[4]]
    docs = spark.createDataFrame(
        [(None if i == 3 else 50 - i % 17, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, path string"
    )
    manifest = token_files.write_tokens(docs, str(tmp_path), WORD_BPE, 1, shards=3)
    rows = sorted(token_files.read_tokens(manifest, str(tmp_path)).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(WORD_BPE)
    plain.encode_special_tokens = True
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at = 0
    for doc, row in zip(order, rows, strict=True):
        ids = plain.encode(doc.text or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc.doc_id, at, len(ids))
        assert zlib.crc32(row.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = token_files.write_tokens(docs.limit(0), str(tmp_path), WORD_BPE, 1)
    assert token_files.read_tokens(empty, str(tmp_path)).count() == 0
