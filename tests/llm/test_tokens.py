"""Token ids, the coder, token files and packing."""

import random
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexicask.llm import codec, packing, tokenfiles, tokenids

TEXTS = [None, "", " \n ", "Hello, world!", "it's we'll DON'T 'S", "naïve CAFÉ Straße été ﬁ ǅ İstanbul ΣΑΣ", "a b c　d\x1ce", "<|endoftext|>x <|startoftext|>", "x2 ½ Ⅻ 123", "你好 नमस्ते 😀😀", "<|ENDOFTEXT|> A. <|endoftext|>. B,", "a., b,. c». d×, É, é. 5, x.\x1c y.\x85 z.", "A.B. C.,\tD,\vE.\nf.", "!!! ... a.b,c", "word " * 3000, "z" * 5000, "ÿ×÷ÀÖØ", "\x00\x01 ﻿"]


@lru_cache(1)
def tokenizer():
    return Tokenizer.from_file(tokenids.default_path())


def expected(text, end):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def test_ids_are_the_tokenizers_own(monkeypatch):
    for memory in (900_000, 3):
        monkeypatch.setattr(tokenids, "MEMORY", memory)
        got = tokenids.Tokens().of_column(pa.array(TEXTS), 7)
        for text, ids in zip(TEXTS, got):
            assert np.frombuffer(ids, "<u4").tolist() == expected(text, 7), text


def test_ids_of_another_file(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    assert not tokenids.has_rules(other) and tokenids.has_rules(tokenizer())
    want = [other.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    got = tokenids.Tokens(path).of_column(pa.array(TEXTS), 7)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x + [7] for x in want]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tokenfiles.write(df, f"file://{tmp_path}/other", end=9, tokenizer=path)
    assert {r.doc_id: r.ids for r in tokenfiles.read_documents(spark, f"file://{tmp_path}/other").collect()} == {k: x + [9] for k, x in enumerate(want)}
    pieces = packing.pack(df, tokenizer=path, with_ids=True, parts=2).collect()
    assert all(r.ids == (want[r.doc_id] + [2])[r.start : r.start + r.length] for r in pieces) and sum(r.length for r in pieces) == sum(len(x) + 1 for x in want)


def test_ids_of_random_texts():
    rng = random.Random(3)
    letters = "..,,$!\"<|>-_`aAbBéÉßñ×÷»'’sStTlL.,!?;: \t\n0½#中अ́ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for text, ids in zip(texts, tokenids.Tokens().of_column(pa.array(texts), 2)):
        assert np.frombuffer(ids, "<u4").tolist() == expected(text, 2), text


@pytest.mark.parametrize("n", [0, 1, 2, 47, 48, 97, 5000, 120_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.minimum(rng.zipf(1.3, n), 49407), np.full(n, 49407), np.arange(n) % 50):
        ids = ids.astype(np.uint32)
        block = codec.encode_block(ids, 49408)
        assert (codec.decode_block(block) == ids).all()
    if n == 120_000:
        assert len(block) < n / 2  # a cycle of 50 ids is predicted


def test_damage_is_found():
    block = codec.encode_block(np.arange(3000) % 700, 49408)
    for at in (0, 5, 30, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 64
        with pytest.raises((codec.Corrupt, ValueError, OverflowError)):
            codec.decode_block(bytes(bad))
    with pytest.raises(codec.Corrupt):
        codec.decode_block(block[:10])
    with pytest.raises(ValueError):
        codec.encode_block(np.array([9]), 9)


def test_token_files(spark, tmp_path, monkeypatch):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = f"file://{tmp_path}/ids"
    tokenfiles.write(df, path, end=1)
    got = sorted(tokenfiles.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    start = 0
    for r in got:
        ids = expected("no id" if r.doc_id is None else TEXTS[r.doc_id], 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    whole = {r.start: r.ids for r in tokenfiles.read_documents(spark, path).collect()}
    assert all(len(whole[r.start]) == r.n_tokens for r in got)
    tokenfiles.write(df.limit(0), f"file://{tmp_path}/none")
    assert tokenfiles.digests(spark, f"file://{tmp_path}/none").count() == 0


def test_a_long_text_fills_blocks():
    ids = np.arange(codec.MOST + 5, dtype=np.uint32) % 100
    frames = tokenfiles._frames(ids.tobytes(), 200)
    parts = list(tokenfiles.blocks(frames))
    assert [len(x) for x in parts] == [codec.MOST, 5] and (np.concatenate(parts) == ids).all()


def test_hilbert_curve_is_one_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, curve string").repartition(3)
    for length in (64, 4096):
        got = packing.pack(df, length=length, end=2, parts=2, with_ids=True).collect()
        pieces, sequences = {}, {}
        for r in got:
            assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes())
            pieces.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for doc_id, found in pieces.items():
            ids = expected("no id" if doc_id is None else TEXTS[doc_id], 2)
            times = 2 if doc_id == 3 else 1
            assert sum(len(x) for _, x, _ in found) == times * len(ids) and all(x == ids[s : s + len(x)] and n == len(ids) for s, x, n in found)
        for found in sequences.values():
            end = 0
            for offset, n in sorted(found):
                assert offset == end
                end += n
            assert end == length or end & (end - 1) == 0 and end < length
        assert set(pieces) == {None, *range(len(TEXTS))}
    assert packing.pack(df.limit(0)).count() == 0


def test_many_rows_in_a_batch(spark, tmp_path):
    """More documents in one Arrow batch than are worked on together."""
    n = 3 * packing.GROUP + 7
    df = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    got = packing.pack(df, parts=1).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(got) == n and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)
    tokenfiles.write(df, f"file://{tmp_path}/many")
    assert sorted(r.doc_id for r in tokenfiles.digests(spark, f"file://{tmp_path}/many").collect()) == list(range(n))


def test_neighbours_on_the_curve(spark, sf):
    """Texts of one language lie together more often than in the order of doc_ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    order = np.argsort(packing.curve_keys(pa.array(docs.text)), kind="stable")
    lang = docs.lang.to_numpy()
    together = lambda x: (x[1:] == x[:-1]).mean()
    assert together(lang[order]) > together(lang) + 0.1


def test_slices():
    from lexicask.llm.common import slices

    for texts in ([], ["a"], ["x" * 50] * 9 + [None, "", "y" * 500] + ["z"] * 700):
        batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": pa.array(texts, pa.string())})
        parts = list(slices(batch, rows=100, most=120))
        assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(len(texts)))
        assert all(p.num_rows == 1 or p.num_rows <= 100 and sum(len(t or "") for t in p.column("text").to_pylist()) <= 120 for p in parts)


def test_a_known_chunk_is_looked_up_once(monkeypatch):
    """Each distinct chunk is learnt once, when a text first needs it; ids that left the newer half of the memory come from the older one."""
    learnt, worker = [], tokenids.Tokens()
    learn = tokenids.Tokens._learn
    monkeypatch.setattr(worker.known, "learn", lambda chunk: learnt.append(chunk) or learn(worker, chunk))
    texts = [b"the cat, the Dog", b"the dog, 12 cats", b"The cat ,"]
    assert worker.of_texts(texts, 1) == worker.of_texts(texts, 1)
    assert sorted(learnt) == sorted(set(learnt)) == sorted([b"the", b"cat", b",", b"dog", b"12", b"cats"])
    ids = [np.array(worker.tokenizer.encode(t.decode(), add_special_tokens=False).ids + [1], "<u4").tobytes() for t in texts]
    assert worker.of_texts(texts, 1) == ids
    monkeypatch.setattr(tokenids, "MEMORY", 0)
    assert [x for t in texts for x in worker.of_texts([t], 1)] == ids
