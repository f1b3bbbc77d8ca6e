"""Tokenisation, packing, BPE and token files against the tokenizers library."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, packing, tokenfiles, tokens
from quern.llm.common import shared_dir

ALPHABET = [*"aBcé'sStrdvelm 12 \n\t.,!?…€-_́İ ​　中Σσς<|ªº²½ ßÀŐǅ\x1c\x85", "'re", "'LL", "<|endoftext|>", " ", "  "]


def library():
    return tokens.library_tokenizer(tokens.vocabulary_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoder_equals_library():
    texts = odd_texts(4000, 1)
    ids, bounds = tokens.WordEncoder(tokens.vocabulary_path()).encode(pa.array([*texts, None]))
    for k, text in enumerate([*texts, ""]):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(text), text


def test_words_differing_in_case_or_neighbours_are_encoded_once(monkeypatch):
    seen = []
    encode = tokens.WordEncoder._encode_words
    monkeypatch.setattr(tokens.WordEncoder, "_encode_words", lambda self, words: seen.extend(words) or encode(self, words))
    texts = ["The cat THE (the) cat.", "", "the, Cat's tHe"]
    ids, bounds = tokens.WordEncoder(tokens.vocabulary_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ids_of(x) for x in texts]
    assert sorted(seen) == ["'s", "(", ")", ",", ".", "cat", "the"]


def test_encoder_forgets_when_full():
    encoder = tokens.WordEncoder(tokens.vocabulary_path(), max_words=3)
    for text in ("one two three four five", "six seven eight nine", "one two"):
        assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(text)


def test_plain_characters_equal_library():
    # each is lowered and split by Arrow, not by the library: alone, within a word, and next to others of all kinds
    every = list(map(chr, range(0x2100)))
    plain = [c for c, is_plain in zip(every, tokens.plain_texts(pa.array(every, pa.large_string()))[1], strict=True) if is_plain]
    assert len(plain) > 600
    texts = [x for c in plain for x in (c, f"A{c}b'{c}S", f"{c}{c} 1{c}.{c}'")]
    ids, bounds = tokens.WordEncoder(tokens.vocabulary_path()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(text), text


def test_bpe_equals_library():
    model = bpe.bpe(tokens.vocabulary_path())
    for text in odd_texts(4000, 2):
        ids = ids_of(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library().decode(ids, skip_special_tokens=False)


def test_bpe_query_of_odd_documents(docs):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(docs).collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(r.text)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library().decode(ids, skip_special_tokens=False))))
    assert rows == want


def test_bpe_merges_each_word_once(monkeypatch):
    model, merged = bpe.bpe(tokens.vocabulary_path()), []
    word = bpe.Bpe.word
    monkeypatch.setattr(bpe.Bpe, "word", lambda self, w: merged.append(w) or word(self, w))
    words = ["".join(x) for x in itertools.product("abcdefghijklmnopqr", repeat=4)]  # 104,976, more than were kept once
    texts = [" ".join(words), " ".join(words).upper(), ", ".join(words)]
    known: dict = {}
    rows = [bpe.encode_batch(model, pa.RecordBatch.from_arrays([pa.array([x])], names=["text"]), known)[0] for x in texts]
    assert len(merged) == len(set(merged)) == len(words) + 1
    for text, (n, digest, _) in zip(texts, rows, strict=True):
        ids = ids_of(text)
        assert (n, digest) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_bpe_tables_round_trip(docs):
    encoded = bpe.bpe_encode(docs)
    decoded = bpe.bpe_decode(encoded)
    assert encoded.count() == decoded.count() == docs.count()
    by_id = {r.doc_id: r.text for r in decoded.collect()}
    assert by_id[5] == library().decode(ids_of("The cat sat on the mat."), skip_special_tokens=False)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 682, 1023, 1024, 1025, 2047, 2048, 2049, 9999])
def test_cut_lengths(n):
    pieces = packing.cut_lengths(n, 2048, 64)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)
    assert all(p <= 64 or 2048 // (2048 // p) == p for p in pieces)


def check_packing(docs, rows, capacity):
    rows = [r.asDict() for r in rows]
    # each id lies in exactly one piece (repeated rows as often as they occur)
    want: dict = {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append([*ids_of(r.text), tokens.END_ID])
    have: dict = {}
    for r in rows:
        have.setdefault(r["doc_id"], []).append(r)
    assert want.keys() == have.keys()
    for doc, copies in want.items():
        ids = copies[0]
        cover = np.zeros(len(ids), int)
        for r in have[doc]:
            cover[r["start"] : r["start"] + r["length"]] += 1
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
        assert (cover == len(copies)).all()
    # sequences hold at most the capacity and have no gap
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(r["length"] for r in rows))


def test_packing_of_odd_documents(docs):
    check_packing(docs, packing.pack_documents(docs).collect(), 2048)


def test_packing_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    assert check_packing(docs, rows, 2048) < 0.01
    full = [r for r in rows if r.bin_class]
    counts: dict = {}
    for r in full:
        counts.setdefault((r.sequence_id, r.bin_class), 0)
        counts[r.sequence_id, r.bin_class] += 1
    assert all(n == kind for (_, kind), n in counts.items())


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.empty(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 2**32, 1000, dtype=np.uint64).astype(np.uint32), rng.integers(0, 49408, 777).astype(np.uint32)):
        for width in (1, 8):
            assert (tokenfiles.from_planes(tokenfiles.to_planes(ids, width), len(ids), width) == ids).all()


@pytest.mark.parametrize(("block", "width"), [(64, 1), (1000, 8), (1 << 16, 1)])
def test_token_files(spark, docs, block, width):
    rows = tokenfiles.token_file_round_trip(docs, block=block, width=width).orderBy("part", "seq").collect()
    start, last = 0, None
    texts = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in docs.select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r, (doc, text) in zip(rows, texts, strict=True):
        ids = [*ids_of(text), tokens.END_ID]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), crc(ids))
        start += len(ids)
        assert last is None or (doc >= last)
        last = doc


def test_cut_short_file_is_refused(spark, docs):
    import pyarrow.fs as pafs

    folder = shared_dir(spark, "cut")
    path = tokenfiles.write_token_files(docs, folder).first().path.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-5])
    with pytest.raises(Exception), pafs.LocalFileSystem().open_input_file(path) as f:
        tokenfiles.PlaneReader(f)


def test_empty_tables(no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    assert bpe.bpe_round_trip(no_docs).count() == 0
    assert tokenfiles.token_file_round_trip(no_docs).count() == 0


def test_no_shuffle_in_packing(docs):
    plan = packing.pack_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_key_types(docs):
    assert dict(packing.pack_documents(docs).dtypes)["sequence_id"] == "bigint"
    assert docs.select(F.col("key")).first()[0] == 7
