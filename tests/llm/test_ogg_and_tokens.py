import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from skein.llm import ogg_media as O
from skein.llm import token_repair as R

DOCS = "doc_id long, text string, data string"


def test_page_crc_bit_by_bit():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert O.page_crc(data) == slow(data)


@pytest.mark.parametrize("segments", [2, 7, 255])
def test_packets_over_pages_and_streams(segments):
    rng = np.random.default_rng(segments)
    packets = {s: [rng.bytes(n) for n in (5, 0, 254, 255, 256, 510, 1021, 70_000, 3)] for s in (7, 9)}
    streams = [O.pages(s, p, list(range(0, 10 * len(p), 10)), segments) for s, p in packets.items()]
    data = O.multiplex(streams)
    found, damaged = O.demultiplex(data)
    assert damaged == 0 and {s: x.packets for s, x in found.items()} == packets
    assert all(x.closed and not x.gaps and x.granules[-1] == 80 for x in found.values())
    at = data.rindex(packets[9][7][-60:])
    hurt = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    found, damaged = O.demultiplex(b"junk" + hurt)
    assert damaged >= 2 and found[7].packets == packets[7]
    assert packets[9][7] not in found[9].packets and set(found[9].packets) <= set(packets[9])


def test_stored_texts_come_back(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 576, "x"), (3, "a" * 576, "y"), (None, "é" * 40_000, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.n_bytes): r for r in O.read(O.store(docs)).collect()}
    assert len(got) == 4 and O.read(O.store(docs)).count() == 5
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = O.encode(raw)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert f"seconds={len(payload) / 8000:.3f}" in r.feature and "damaged=0" in r.feature
    assert O.read(O.store(docs.where("false"))).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, int), np.array([3]), np.zeros(5000, int), rng.integers(0, 40, 60_000), np.tile(rng.integers(0, 50_000, 500), 30)):
        data = R.pack(ids.astype("<u4"), 50_257)
        assert R.decode(data) == ids.astype("<u4").tobytes()
        for start, n in ((0, 1), (len(ids) // 3, 17), (max(0, len(ids) - 5), 5)):
            assert R.decode_range(data, start, n).tolist() == ids[start : start + n].tolist()
    base, rules, lengths, s = R.unpack(data)
    assert len(rules) and len(s) < len(ids) and lengths.min() >= 2
    for base in (50_257, 70_000, 1 << 20):
        ids = np.tile(rng.integers(0, base, 3000), 40)
        data = R.pack(ids.astype("<u4"), base)
        assert R.decode(data) == ids.astype("<u4").tobytes() and len(data) * 5 < len(ids) * 4
        _, rules, _, s = R.unpack(data)
        pair, n = np.unique(np.stack([s[:-1], s[1:]], 1), axis=0, return_counts=True)
        assert n[pair[:, 0] != pair[:, 1]].max(initial=0) < R.MIN_COUNT


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 40_000) % 300
    for bits in (6, 20):  # slots that many pairs share
        rules, s = R.compress(ids.astype("<u4"), 300, bits=bits)
        pair, n = np.unique(np.stack([s[:-1], s[1:]], 1), axis=0, return_counts=True)
        assert len(rules) > 200 and n[pair[:, 0] != pair[:, 1]].max() < R.MIN_COUNT
    with pytest.raises(ValueError):
        R.unpack(b"x" * 40)


TEXTS = ["", "a", " a", "a ", "a  b", "x\ny", "x\n\ny \n z", "\n", "tab\tb c\t", "don't we'll", "<|endoftext|> hi <|endoftext|>", "é ñ 日本 12 3", " a b", "a\x1cb", "l\r\nm", "end.\nNext one\n", "hi <|endoftext|> there", "one<|endoftext|>two", "a\u3000\u00a0b", "it's o'clock\n's", "\nWord,*** x", "ſtraße Ⅷ ²x"]


def test_words_encode_as_whole_texts(sf_dir):
    texts = [*TEXTS, *pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, tokenizer = R.WordEncoder(R.tokenizer_path(name)), Tokenizer.from_file(R.tokenizer_path(name))
        whole = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(pa.array(texts))] == whole
    assert whole[0] == [] and tokenizer.encode("a <|endoftext|>", add_special_tokens=False).ids[-1] == 49407


def test_forgotten_words_encode_the_same(monkeypatch):
    monkeypatch.setattr(R, "CACHED_WORDS", 40)
    encoder, tokenizer = R.WordEncoder(R.tokenizer_path()), Tokenizer.from_file(R.tokenizer_path())
    for k in range(30):
        texts = [f"the word of{'abcdefghij'[k % 10] * (k + 1)} and w{k}, {'xyz'[k % 3] * k}.\nNext line{k}" for k in range(k, k + 9)]
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.words) <= 40 + 60


def test_positions(spark):
    rows = [(5, "hello hello hello", "x"), (2, None, "x"), (9, "", None), (None, "ab", "x"), (2, "b", "x"), (2, "b", "y")] + [(100 + k, " ".join(TEXTS) * k, "z") for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    got = R.positions(R.written(R.shards(docs, shard_ids=200), "t")).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(R.tokenizer_path())
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    for r in got:
        want = next(x for x in texts[r.doc_id] if (len(x), zlib.crc32(x.tobytes())) == (r.n_tokens, r.ids_crc32))
        assert r.start == at
        at += len(want)
    assert R.token_positions(docs.where("false")).count() == 0
