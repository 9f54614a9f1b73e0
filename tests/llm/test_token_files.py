from __future__ import annotations

import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kantar.llm import token_files as T

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "  two  spaces  ", " lead", "trail ", "a\nb", "x \n y", "tab\there", "it's 'tis we'll 's", "don't\x1fstop \x1c x", "\xa0nbsp \xa0 x", "é ñ Ž ш 中文 字 , 😀 😀", "<|endoftext|> in text", "1234 56,78 $%& ...", "def f(x):\n    return  x\n\n\n", "a b 　c", "᠎ x ᠎", "ﬁ ǅ ʰ ⅷ ²", "҉ ͸ a͸b"]


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _odd_texts(seed, n):
    rng = random.Random(seed)
    letters = "ab Z.,'  \n\t0é́ ŁЖא中😀<|> \x85\r\x1f\x0bӿԀ԰"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    texts = [*ODD, *_odd_texts(1, 3000), "word " * 5000]
    ask, enc = plain(path), T.Encoder(path)
    want = [ask(t) for t in texts]
    assert enc.in_pieces == (path == BYTES)
    for _ in range(2):
        ids, counts = enc.encode(pa.array(texts))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == want
    sliced, counts = enc.encode(pa.array(texts).slice(3, 5))
    assert sliced.tolist() == [x for t in want[3:8] for x in t] and counts.tolist() == [len(t) for t in want[3:8]]


def test_every_letter_below_the_limit_is_cut_as_the_library_does():
    enc, ask = T.Encoder(BYTES), plain(BYTES)
    for c in map(chr, range(0x500)):
        text = f"a{c}b {c} {c}{c}1{c}, x{c}"
        assert enc.encode(pa.array([text]))[0].tolist() == ask(text), hex(ord(c))


def test_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(T, "KEPT_PIECES", 3)
    enc, ask = T.Encoder(BYTES), plain(BYTES)
    for text in ["one two three four five"] * 3 + ["six seven one"] * 2:
        assert enc.encode(pa.array([text]))[0].tolist() == ask(text)


def test_checksums():
    slow = lambda data: _crc(data)
    assert slow(b"123456789") == 0xE3069283
    rng = random.Random(2)
    parts = [rng.randbytes(n) for n in [0, 1, 3, 8, 63, 64, 65, 127, 128, 129, 1000, 5000, *[rng.randint(0, 700) for _ in range(40)]]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    assert T.crc32c(data, np.cumsum(sizes) - sizes, sizes).tolist() == [slow(p) for p in parts]
    assert T.masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def _crc(data):
    x = 0xFFFFFFFF
    for b in data:
        x ^= b
        for _ in range(8):
            x = (x >> 1) ^ (0x82F63B78 if x & 1 else 0)
    return x ^ 0xFFFFFFFF


def _expected(rows, path=BYTES, end=0):
    import hashlib

    ask, start, out = plain(path), 0, []
    tid = lambda t: hashlib.sha256((t or "").encode()).digest()[:16]
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tid(r[1]))):
        ids = [*ask(text or ""), end]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def _read(df):
    return [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in df.collect()]


@pytest.mark.parametrize(("shards", "path"), [(None, BYTES), (7, BYTES), (3, WORDS)])
def test_files_hold_the_ids_in_order(spark, tmp_path, monkeypatch, shards, path):
    monkeypatch.setattr(T, "PART_BYTES", 3000)
    rows = [(i * 3 % 200, t) for i, t in enumerate([*ODD, *_odd_texts(5, 150)])]
    rows += [(None, None), (None, "null id"), (5, "tie b"), (5, "tie a"), (-7, "below zero"), (9, "alike"), (9, "alike"), (10, "long " * 30_000)]
    rows += [(77, "hot id")] * 300
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, tid int, row binary").repartition(6)
    where = str(tmp_path / "out")
    T.write_tokens(df, where, path, shards=shards)
    want = _expected(rows, path)
    assert sorted(_read(T.read_tokens(spark, where)), key=lambda r: r[1]) == want
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert sum(s["records"] for s in manifest["shards"]) == len(rows) and manifest["tokens"] == sum(len(i) for *_, i in want)
    if shards:
        # A hot id is spread over shards, in spite of the order by id.
        assert len(manifest["shards"]) > 2 and max(s["records"] for s in manifest["shards"]) < 0.7 * len(rows)
    index = {r.start: r for r in T.read_index(spark, where).collect()}
    assert sorted(index) == [s for _, s, _ in want] and all(index[s].n_tokens == len(i) for _, s, i in want)


def test_frames_can_be_read_from_the_beginning_without_an_index(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)]
    where = tmp_path / "out"
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(where), BYTES, shards=1)
    data, at, got = next(where.glob("*.records")).read_bytes(), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        body = data[at + 12 : at + 12 + n]
        mask = lambda x: (((x >> 15) | (x << 17)) + 0xA282EAD8) & 0xFFFFFFFF
        assert int.from_bytes(data[at + 8 : at + 12], "little") == mask(_crc(data[at : at + 8]))
        assert int.from_bytes(data[at + 12 + n : at + 16 + n], "little") == mask(_crc(body))
        got.append((int.from_bytes(body[:8], "little"), np.frombuffer(body[12:], "<u2").tolist()))
        at += n + 16
    assert got == [(d, ids) for d, _, ids in _expected(rows)]


def test_damage_is_seen(spark, tmp_path):
    where = tmp_path / "out"
    T.write_tokens(spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string"), str(where), BYTES, shards=1)
    file = next(where.glob("*.records"))
    whole = file.read_bytes()
    for at in (3, 10, 30, len(whole) - 2):
        file.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception, match="checksum"):
            T.read_tokens(spark, str(where)).collect()


def test_shuffled_reads(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, shards in enumerate((1, 6)):
        T.write_tokens(df, str(tmp_path / str(k)), BYTES, shards=shards)
    monkeypatch.setattr(T, "CHUNK", 500)
    told = [T.shuffled(spark, str(tmp_path / str(k)), seed, readers=3).collect() for k, seed in ((0, 1), (1, 1), (0, 2))]
    orders = [[r.doc_id for r in x] for x in told]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) == list(range(400)) != orders[0]
    assert all([r.place for r in x] == sorted(r.place for r in x) for x in told)
    want = {d: ids for d, _, ids in _expected(rows)}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] for x in told for r in x)


def test_empty_table_and_lost_tasks(spark, tmp_path):
    df = spark.createDataFrame([(1, "kept")], "doc_id long, text string")
    T.write_tokens(df.limit(0), str(tmp_path / "none"), BYTES)
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0 and T.read_index(spark, str(tmp_path / "none")).count() == 0
    T.write_tokens(df, str(tmp_path / "one"), BYTES)
    # What a lost attempt left is not in the manifest and is not read.
    (tmp_path / "one/shard-lost.records").write_bytes(b"half a frame")
    assert [r.doc_id for r in T.read_tokens(spark, str(tmp_path / "one")).collect()] == [1]


def test_query_against_brute_force_on_the_whole_table(spark):
    where = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    want = [(d, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, ids in _expected(rows)]
    assert sorted(map(tuple, T.op11_token_files(spark, where).collect()), key=lambda r: r[1]) == want
    assert not list(Path("/tmp").glob("shard-*"))
