"""Token counts and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelens.llm import idcodec, tokens
from tracelens.llm import token_output as O
from tracelens.llm.token_counts import count_text, token_counts
from tracelens.llm.token_output import group_records, ids_of, parse, text_ids, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\t", "the The THE", "it's we'll o'clock", "a b c", "é ́x", "x\x1cy\x85z", "<|endoftext|> <|startoftext|>x", "naïve ÉCOLE ß İ ΑΣ", "12 345 ½ ٣", "!!!... —…", "😀👍🏽", "a" * 3000, "﻿bom", "日本語 テスト", "\x00\x01"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_count_and_encode_like_the_library(text):
    assert count_text(text.encode(), PATH) == len(ids(text))
    assert np.frombuffer(text_ids(text.encode(), PATH), "<u4").tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_like_the_library(text):
    raw = text.encode("utf-8", "ignore")
    assert count_text(raw, PATH) == len(ids(raw.decode()))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=tokens.ODD_FROM), max_size=60))
def test_any_text_that_is_split_here_encodes_like_the_library(text):
    assert np.frombuffer(text_ids(text.encode(), PATH), "<u4").tolist() == ids(text)


def test_whole_tokens_are_proven():
    found = tokens.whole_tokens(PATH)
    assert len(found) > 10_000
    for word in random.Random(1).sample(sorted(found), 200):
        assert ids(word) == [found[word]]


def test_memo_forgets_what_is_not_asked_for(monkeypatch):
    memo = tokens.Memo(PATH, tokens.count_of)
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    words = [b"zzqx", b"qqzzv", b"xkcdq", b"l" * 1000, "é\u0301".encode()]
    assert [sum(v) for v in memo.of_texts(words)] == [len(ids(w.decode())) for w in words]
    assert b"zzqx" in memo and b"l" * 1000 not in memo
    memo.trim()
    assert not memo and not memo.merges and b"zzqx" in memo.old
    assert sum(next(memo.of_texts([b"zzqx, ZZqx the"]))) == 2 * len(ids("zzqx")) + 2
    assert b"zzqx" in memo and b"xkcdq" not in memo
    list(memo.of_texts([b"a1 b2 c3 d4"]))
    memo.trim()
    assert b"xkcdq" not in memo.old and b"zzqx" in memo.old


def test_counts_of_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", "x", 5), (1, "the cat", "y", 6), (None, None, None, None), (3, "", "z", 7)], "doc_id LONG, text STRING, n_tokens STRING, id INT")
    rows = sorted(map(tuple, token_counts(docs, PATH, limit=1).collect()), key=str)
    assert rows == sorted([(1, 7, 2, True), (1, 7, 2, True), (None, 0, 0, False), (3, 0, 0, False)], key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n, block", [(0, 8), (1, 8), (8, 8), (9, 8), (1000, 64), (5000, 700)])
@pytest.mark.parametrize("kind", ["random", "skewed", "cycle", "constant"])
def test_codec_round_trip(n, block, kind):
    rng = np.random.default_rng(n)
    a = {"random": rng.integers(0, 65536, n), "skewed": (rng.pareto(0.7, n) * 3).astype(np.int64) % 49408, "cycle": np.arange(n) % 37, "constant": np.full(n, 65535)}[kind]
    coded = idcodec.encode_blocks(a, block)
    assert len(coded) == -(-n // block)
    if n:
        assert (idcodec.decode_blocks(coded, min(n, block)).ravel()[:n] == a).all()


@pytest.mark.parametrize("odd", [65536, 1 << 31, -1])
def test_codec_refuses_ids_beyond_two_bytes(odd):
    with pytest.raises(ValueError, match="65535"):
        idcodec.encode_blocks(np.array([5, odd, 65535]))
    with pytest.raises(ValueError, match="65535"):
        list(group_records([(5, 2)], np.array([5, odd])))


def test_codec_adapts():
    a = np.tile(np.random.default_rng(1).integers(0, 49408, 40), 100)
    assert sum(map(len, idcodec.encode_blocks(a))) < 0.2 * 2 * len(a)


def test_blocks_are_independent_and_checksummed():
    a = np.random.default_rng(2).integers(0, 49408, 9000).astype("<u4")
    data = b"".join(r + b"\n" for r in group_records([(5, 9000)], a))
    (docs, blocks), = parse(data)
    assert docs == [(5, 9000)] and len(blocks) == 3
    assert (ids_of(blocks[1:2]) == a[4096:8192]).all()
    n, payload, crc = blocks[0]
    with pytest.raises(ValueError, match="checksum"):
        ids_of([(n, payload, crc ^ 1)])
    with pytest.raises(ValueError):
        list(parse(data[:-200]))


def expected(rows, end=1):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        own = np.array([*ids(text or ""), end], "<u4")
        out.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


def test_long_groups_are_coded_a_few_blocks_at_once(monkeypatch):
    """One long text is a group of its own: the coder's tables are bounded all the same, and the bytes do not depend on it."""
    a, seen = np.arange(5 * 4096 + 7) % 900, []
    whole = list(group_records([(5, len(a))], a))
    for name, lanes in (("encode_blocks", lambda ids: -(-len(ids) // 4096)), ("decode_blocks", lambda blocks, _: len(blocks))):
        f = getattr(O, name)
        monkeypatch.setattr(O, name, lambda *x, f=f, lanes=lanes: seen.append(lanes(*x)) or f(*x))
    monkeypatch.setattr(O, "LANES", 2)
    parts = list(group_records([(5, len(a))], a))
    (docs, blocks), = parse(b"".join(r + b"\n" for r in parts))
    assert parts == whole and docs == [(5, len(a))] and (ids_of(blocks) == a).all()
    assert seen == [2, 2, 2, 2, 2, 2]


def test_token_files_of_every_document(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = token_output(docs, PATH, path=str(tmp_path / "tokens")).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert list((tmp_path / "tokens").glob("part-*"))


def test_token_files_of_many_groups_are_read_in_order(spark, data, monkeypatch, tmp_path):
    from tracelens.llm import token_output as O

    monkeypatch.setattr(O, "PER_FILE", 2)
    monkeypatch.setattr(O, "LANES", 1)
    docs = spark.read.parquet(f"{data}/documents.parquet").coalesce(1)
    found = token_output(docs, PATH, path=str(tmp_path / "many")).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_token_files_with_nulls_ties_and_long_texts(spark):
    rows = [(7, "b a"), (7, "a b"), (7, "a b"), (None, "null id"), (2, None), (-3, ""), (9, "word salad " * 9000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id LONG, text STRING, start INT")
    assert sorted(map(str, map(tuple, token_output(docs, PATH).collect()))) == sorted(map(str, expected(rows)))
    assert token_output(docs.limit(0), PATH).count() == 0


def test_token_counts_of_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = token_counts(spark.read.parquet(f"{data}/documents.parquet"), PATH).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(ids(r.text or "")), n > 2048) for r in docs]
    assert sorted(map(tuple, found)) == sorted(want)
