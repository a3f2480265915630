import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from galefold.llm import packing, token_files
from galefold.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_whole_text_s_ids(name, monkeypatch):
    rng = random.Random(3)
    bits = ["a", " b", "\n", "\t", "  ", "\r\n", "'s", "é", "é", "12", "###", "<|endoftext|>", " ", " ", "Σ", "ΑΣ", "\x1c", "日本", "don't", "Word,", " Word.", "x%%%", "İ", "ǅ", "​", "$"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "\n", " ", "word " * 500]
    monkeypatch.setattr("galefold.llm.tokens.CACHE_PIECES", 500)
    e = Encoder(public_tokenizers.path(name))
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        want = [x.ids for x in e.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(part)] == want


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_levels_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    levels = token_files.split_levels(ids)
    assert np.array_equal(token_files.join_levels(levels), ids)
    for i in rng.integers(0, n, 50) if n else []:
        assert token_files.access(levels, int(i)) == ids[i]


def whole(docs, name, end):
    t = Encoder(public_tokenizers.path(name)).tokenizer
    rows = docs.select("doc_id", "text").collect()
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op1_against_whole_encoding(spark, tidy):
    got = [tuple(r) for r in token_files.op1(spark, tidy).orderBy("doc_id").collect()]
    start, want = 0, []
    for doc_id, ids in sorted(whole(tidy, FILES[1], 1)):
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_files_hold_any_token(spark, tidy, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 700)
    manifest = token_files.write_token_files(tidy, public_tokenizers.path(FILES[1]))
    everything = [i for _, ids in sorted(whole(tidy, FILES[1], 1)) for i in ids]
    rng = random.Random(1)
    for f in manifest.collect():
        file = token_files.TokenFile(f.uri)
        for i in rng.sample(range(f.n_tokens), min(40, f.n_tokens)):
            assert file.token(i) == everything[f.start + i]
        file.close()


def test_op1_odd_rows(spark, messy, nothing):
    got = token_files.op1(spark, messy).orderBy("start").collect()
    assert len(got) == messy.count() and got[0].doc_id is None
    ids = [r.doc_id for r in got[1:]]
    assert ids == sorted(ids) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_files.op1(spark, nothing).count() == 0


@pytest.mark.parametrize("table", ["tidy", "messy"])
def test_op9_pieces_and_sequences(spark, request, table):
    docs = request.getfixturevalue(table)
    rows = packing.op9(spark, docs).collect()
    want = sorted(((d is None, d or 0), crc(ids[a : a + n]), k, a, n) for d, ids in whole(docs, FILES[0], 0) for k, (a, n) in enumerate(packing.pieces_of(len(ids), 2048)))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids_crc32, r.piece, r.start, r.length) for r in rows) == want
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def test_op9_nothing(spark, nothing):
    assert packing.op9(spark, nothing).count() == 0


def test_best_fit_places_like_a_plain_search():
    rng = random.Random(4)
    fast, bins, order, n_bins = packing.BestFit(100, 5), {}, [], 0
    for _ in range(3000):
        n = rng.randint(1, 100)
        got = fast.place(n)
        fits = [f for f in bins.values() if f >= n]
        if not fits and len(bins) >= 5:
            least = min(bins.values())
            del bins[next(b for b in reversed(list(bins)) if bins[b] == least)]
        free = min(fits) if fits else 100
        number, offset = got
        assert offset == 100 - free and (bins.pop(number) == free if fits else number == n_bins)
        n_bins += not fits
        if free > n:
            bins[number] = free - n
        assert len(bins) <= 5
    assert packing.pieces_of(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.pieces_of(4096, 2048) == [(0, 2048), (2048, 2048)]
