import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galefold.llm import chat, collocations, vafile

# -- collocations ------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, share, top):
    count = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                count["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        most = Counter()
        for k, v in candidates.items():
            for size in range(2, len(k)):
                for i in range(len(k) - size + 1):
                    most[k[i : i + size]] = max(most[k[i : i + size]], v)
        found = []
        for k, a in candidates.items():
            score, _, left, right = min((2000000 * a // (f[k[:c]] + f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
            if 100 * most[k] < share * a:
                found.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def spoken(rng, n):
    stock = ["new", "york", "city", "hall", "a", "Ab", "é", "日本", "x" * 40, "x" * 39 + "y", "\x1f"]
    return "".join(rng.choice(stock) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for _ in range(n))


@pytest.mark.parametrize("bits", [64, 6])
def test_op11_against_plain_counts(spark, messy, bits):
    rng = random.Random(11)
    more = [(k % 400, spoken(rng, rng.randint(0, 60)), rng.choice(["en", "fr", None, ""])) for k in range(500)]
    more += [(k, "very long " * 5000 + "end", "en") for k in range(2)]
    docs = messy.select("doc_id", "text", "lang", F.lit(1).alias("n"), F.lit("x").alias("phrase")).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string").repartition(5).withColumns({"n": F.lit(2), "phrase": F.lit(None).cast("string")}))
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = collocations.collocations(docs, least=5, top=50, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 5, 80, 50)


def test_op11_empty_and_large_counts(spark, nothing):
    assert collocations.op11(spark, nothing).count() == 0
    phrases = spark.createDataFrame([("en", "a", 3 * 10**18), ("en", "b", 3 * 10**18), ("en", "a b", 2 * 10**18), ("en", "b a", 1)], "lang string, phrase string, f long")
    assert sorted((r.phrase, r.score) for r in collocations.scored(phrases).collect()) == [("a b", 666666), ("b a", 0)]


def test_words_of_equal_hashes_come_apart():
    b = collocations.block_of([b"one two, One three", b"x" * 50 + b" two two", b"x" * 49 + b"z"])
    same = collocations.exact_words(b, np.zeros(len(b.begin), np.uint64))
    words = [bytes(b.data[i:j]) for i, j in zip(b.begin, b.end, strict=True)]
    assert [words[k] for k in same] == words and len(set(same.tolist())) == len(set(words))
    up = b.piece[1] != b.piece[2]
    assert up and words[2] == b"one" and b.piece[4] != b.piece[3]


# -- chat --------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<", "</", "[", " [/INST]", "[IMG]", "![a](b.png) and <audio src=\"x.mp3\" seconds=\"2.5\">", "![no](", "<document src=\"d\" pages=3>\\", "[ROLE] x[:] y [/ROLE]", "é日\U0001F600", "", "\n\n", "<<s>s>"]


def plain_digest(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", NASTY)
def test_turns_come_back(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@pytest.mark.parametrize("segment_chars", [1, 200, chat.SEGMENT])
def test_op12_against_plain_digests(spark, segment_chars):
    rng = random.Random(segment_chars)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 6) if conv != 3 else 400):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "[:]", None]), rng.choice([None, "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 5)))]), 1.5))
    rows.append((50, 0, "assistant", "long " * 300_000, None))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body double").repartition(4)
    formatted = chat.format_conversations(frame, segment_chars=segment_chars)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.read_back(formatted)).collect()}
    want = defaultdict(list)
    for conv, _, role, text, _ in rows:
        want[conv].append((role, text))
    assert got == {k: plain_digest(v) for k, v in want.items()}
    if segment_chars == 1:
        assert formatted.where("conv_id = 3").count() == 400


def test_op12_ties_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "assistant", "first")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op12(spark, frame).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == plain_digest([("assistant", "first"), ("user", "b"), ("user", "b")])[1]
    assert [r.conv_id for r in chat.op12(spark, frame.limit(0)).collect()] == [-7]
    text = "</s>[INST] ok [/INST]"
    assert tuple(got[-7])[:5] == (-7, *plain_digest([("user", text), ("assistant", text)]))


def test_typed_parts_are_placeholders_in_order(spark):
    part = lambda type, **x: {"type": type} | dict.fromkeys(["text", "ref", "width", "height", "seconds", "pages"]) | x
    parts = [part("text", text="see [IMG]: "), part("image", ref="a.png", width=29, height=14), part("audio", ref="b.mp3", seconds=2.0), part("document", ref="c.pdf", pages=3), part("text", text=None), part("image", ref=None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(rows).collect()[0]
    assert r.formatted == "[INST] see [\\IMG]: [IMG][AUD][DOC][IMG] [/INST]</s>"
    assert [(a.kind, a.ref, a.tokens, r.formatted[a["at"] : a["at"] + 5]) for a in r.attachments] == [("image", "a.png", 3, "[IMG]"), ("audio", "b.mp3", 50, "[AUD]"), ("document", "c.pdf", 1536, "[DOC]"), ("image", None, 576, "[IMG]")]
    assert [(s.start, s.stop) for s in r.loss] == [(len(r.formatted) - 4,) * 2]
    with pytest.raises(ValueError):
        chat.Flattener().visit(part("video"))


# -- clustering --------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [list(y) for _, y in start]
    far = lambda y, c: sum((a - b) ** 2 for a, b in zip(y, c, strict=True))
    nearest = lambda y: min(range(len(centres)), key=lambda c: (far(y, centres[c]), c))
    for _ in range(rounds):
        own = [nearest(y) for _, y in kept]
        for c in range(len(centres)):
            members = [y for (_, y), o in zip(kept, own, strict=True) if o == c]
            if members:
                centres[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = [(i, nearest(y), y) for i, y in kept]
    out = [(i, c, far(y, centres[c])) for i, c, y in out]
    total = Counter()
    for _, c, d in out:
        total[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i is None, i or 0, c, fits(d), fits(total[c]), fits(sum(total.values())), digest[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("seed,spread", [(0, 0.3), (1, 0.02), (2, 2.0**17)])
def test_op13_against_plain_rounds(spark, seed, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(12)]
    rows = [(k if k % 50 else k % 3, [rng.gauss(x, spread / 2) for x in rng.choice(centres)]) for k in range(300)]
    rows += [(900, rows[0][1])] * 20 + [(901, rows[1][1])] * 2 + [(None, rows[2][1]), (902, None), (903, rows[3][1][:63]), (904, [*rows[4][1][:63], None]), (905, [*rows[5][1][:63], float("nan")]), (906, [*rows[5][1][:63], float("-inf")]), (907, [])]
    rows = [(i, v, -1) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").repartition(5)
    got = vafile.op13(spark, frame)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = plain_clusters([(i, v) for i, v, _ in rows], 8, 10, 64)
    assert sorted(((r.vec_id is None, r.vec_id or 0, *tuple(r)[1:]) for r in got.collect()), key=str) == want


def test_op13_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64), (2, [-0.5] * 64)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance, r.inertia) for r in vafile.op13(spark, frame).collect()) == [(1, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert vafile.op13(spark, frame.limit(0)).collect() == []


def test_cells_bound_distances_and_settle_most():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (8, 64))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-200, 200, (3000, 64))
    cells = vafile.cells_of(x[:500], x.min(axis=0), x.max(axis=0))
    codes = vafile.encoded(x, cells)
    assert (vafile.unpacked(vafile.packed(codes), 64) == codes).all() and codes.max() < 16
    nearest = vafile.Nearest(centres, cells)
    least, most = nearest.intervals(codes)
    far = nearest.distances(x)
    assert (least <= far).all() and (far <= most).all()
    fetched = []
    assert (nearest.of(codes, lambda rows: fetched.extend(rows) or x[rows]) == far.argmin(axis=1)).all()
    assert len(fetched) < 300 and (nearest.candidates(codes).sum(axis=1) > 1).sum() == len(fetched)
