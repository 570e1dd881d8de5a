"""The registered queries of this subpackage on the smallest tables: SQL where there is some, brute force elsewhere."""

import hashlib
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from postmill.llm import audio, entry
from postmill.llm.python_queries import codec_of, tokenizer_path
from postmill.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(entry.SQL[name])
    got = entry.QUERIES[name](spark, SF).select(*want.columns).collect()
    plain = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(tuple(r) for r in got) == plain(want.fetchall())


def test_packing_query(spark, documents):
    encode = Encoder(tokenizer_path("byte_bpe_50k.json")).encode_whole
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in entry.QUERIES["op1_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d for d, *_ in documents}
    for d, text, _ in documents:
        ids, at = np.array([*encode(text or ""), 0], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(len(x) for x in pieces.values()) and len(bins) * 1024 < 1.1 * sum(r.length for x in pieces.values() for r in x) + 1024


def scalar_pcm(codec, data):
    """Samples at the codec's rate, one at a time."""
    if codec != "adpcm":
        table = {"mulaw": audio.MULAW, "alaw": audio.ALAW}[codec].tolist()
        return [table[b] for b in data]
    steps, moves, out = audio.STEPS.tolist(), audio.INDEX.tolist(), []
    for a in range(0, len(data), audio.BLOCK):
        block = data[a : a + audio.BLOCK]
        value, index = struct.unpack_from("<h", block)[0], min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = steps[index]
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value + (-change if code & 8 else change)))
                index = max(0, min(88, index + moves[code]))
                out.append(value)
    return out


def test_media_query(spark, documents):
    got = {r.doc_id: r for r in entry.QUERIES["op2_media_audio"](spark, SF).collect()}
    assert set(got) == {d for d, *_ in documents}
    for d, text, _ in documents:
        plain = (text or "").encode()
        payload = plain + b"\xff" * ((-len(plain)) % 576 if plain else 576)
        r, codec = got[d], codec_of(payload)
        media = audio.to_wav(codec, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        x = scalar_pcm(codec, payload)
        y = [v for a, b in zip(x, x[1:] + x[-1:]) for v in (a, (a + b) >> 1)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:]))
        assert r.feature == f"{codec} n={len(y)} rms={(sum(v * v for v in y) / len(y)) ** 0.5:.3f} crossings={crossings} crc={zlib.crc32(np.array(y, '<i2').tobytes()):08x}"


def test_language_query(spark, documents):
    got = {r.doc_id: r for r in entry.QUERIES["op9_language_id"](spark, SF).collect()}
    assert set(got) == {d for d, *_ in documents}
    learned = {lang for d, t, lang in documents if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1}
    right = seen = 0
    for d, text, lang in documents:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in learned | {"und"}
        if r.held_out and lang is not None and r.lang_pred != "und":
            seen, right = seen + 1, right + (r.lang_pred == lang)
    assert seen > 40 and right >= 0.95 * seen


def test_token_file_query(spark, documents):
    encode = Encoder(tokenizer_path("word_bpe_49k.json")).encode_whole
    got, at = {r.doc_id: r for r in entry.QUERIES["op10_token_files"](spark, SF).collect()}, 0
    for d, text, _ in documents:
        ids = [*encode(text or ""), 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(documents)
