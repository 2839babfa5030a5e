"""Scanners stay linear on texts full of beginnings; stores stay bounded; clashing names."""

import struct
import time

import pytest

from factloom.llm import exact_dedup, media, near_dedup, packing, pii, secrets, sentencepiece, simhash

MEDIA = {
    "zip": b"PK\x03\x04" + bytes(26),
    "end of zip": b"PK\x03\x04" + bytes(26) + b"PK\x05\x06" + bytes(18),
    "ftyp": struct.pack(">I4s", 8, b"ftyp"),
    "pdf": b"%PDF-1.4 %%EOF ",
    "ogg": b"OggS\0\2" + bytes(20) + b"\0",
    "jpeg": b"\xff\xd8\xff\xda\0\2",
    "gif": b"GIF89a\1\0\1\0\0\0\0\x21\0",
    "riff": b"RIFF\xf0\xff\0\0WAVEfmt \0\0\0\0",
    "png": b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + bytes(17),
}
TEXTS = ("-----BEGIN A-----\n", "-----BEGIN A-----\n-----BEGIN B-----\n", "eyJ", "eyJa.b.c.d.", "QUJD", "0123456789abcdef", "token= ")


def _seconds(run, unit, size):
    data = unit * (size // len(unit))
    return min(_timed(run, data) for _ in range(2))


def _timed(run, data):
    began = time.perf_counter()
    run(data)
    return time.perf_counter() - began


@pytest.mark.parametrize("name", MEDIA)
def test_sniffing_is_linear(name):
    small, large = (_seconds(media.sniff, MEDIA[name], n) for n in (100_000, 1_000_000))
    assert large < 40 * small + 0.5


@pytest.mark.parametrize("unit", TEXTS)
def test_secret_scan_is_linear(unit):
    small, large = (_seconds(secrets.scan, unit, n) for n in (100_000, 1_000_000))
    assert large < 40 * small + 0.5


def test_key_blocks_pair_with_the_next_end():
    body = "QUJDREVGR0hJSktMTU5P\n"
    text = f"-----BEGIN A-----\n-----BEGIN A-----\n{body}-----END A----- -----BEGIN B-----\n{body}-----END A----- -----END B-----"
    assert [(text[a:b].count("BEGIN"), label) for a, b, label, _ in secrets._pem_blocks(text)] == [(1, "A")]


def test_long_words_are_not_kept():
    encode, codec = packing.WordCachedEncoder(packing.vocabulary_path()), sentencepiece.Codec(sentencepiece.read_pieces(sentencepiece.model_path()))
    long = "日本語" * 2000
    for k in range(5):
        text = f"a {long}{k} b"
        assert encode(text) == encode._encode(text)
        assert codec.decode(codec.encode(text)) == text
    assert sum(map(len, encode._chunks)) < 100 and sum(map(len, codec.known)) < 100


def test_stores_start_afresh(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    monkeypatch.setattr(sentencepiece, "CACHE_BYTES", 2000)
    encode, codec = packing.WordCachedEncoder(packing.vocabulary_path()), sentencepiece.Codec(sentencepiece.read_pieces(sentencepiece.model_path()))
    for k in range(200):
        text = " ".join(f"word{k}x{j}" for j in range(5))
        assert encode(text) == encode._encode(text) and codec.decode(codec.encode(text)) == text
    assert len(encode._chunks) < 40 and len(codec.known) < 40


def test_columns_with_the_names_of_internal_ones(spark):
    rows = [(1, "Mr Moss wrote this line of words", 7, 0), (2, "Mr Moss wrote this line of words", 7, 0), (3, "other", 7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _factloom_row long, _row int")
    got = {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: 2, 2: 2, 3: 1}
    for operator in (exact_dedup, simhash, near_dedup):
        out = operator.deduplicate(docs)
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert pii.replace_personal_data(docs).count() == 3
    stored = media.store_payloads(docs).withColumnRenamed("n_bytes", "kind")
    described = media.describe_media(stored, ["doc_id", "kind"])
    assert described.columns[:2] == ["doc_id", "input_kind"] and described.count() == 3
