import random
import re

import numpy as np
import pytest
import xxhash

from galefold.llm import simhash, substrings
from galefold.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    w = WORD.findall(lower(text))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("table", ["tidy", "messy"])
def test_op2_against_all_pairs(spark, request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    root = groups_of(len(rows), [(a, b) for b in range(len(rows)) for a in range(b) if (rows[a][1] ^ rows[b][1]).bit_count() <= 2])
    least: dict = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(((d is None, d or 0), f"{f:016x}", least[r]) for (d, f), r in zip(rows, root, strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.op2(spark, docs).collect()) == want


def test_op2_nothing(spark, nothing):
    assert simhash.op2(spark, nothing).count() == 0


def clustered(rng, n):
    """Codes around a few centres, so that nodes are large and links many."""
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    out = set()
    while len(out) < n:
        c = int(centres[rng.integers(0, 6)])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            c ^= 1 << int(b)
        out.add(c)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_gray_tree_search_is_exact(radius):
    rng = np.random.default_rng(radius)
    codes = clustered(rng, 700)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    q, c, far = simhash.GrayTree(codes).search(codes, radius)
    want = {(a, b) for a in range(700) for b in np.nonzero(np.bitwise_count(codes ^ codes[a]) <= radius)[0].tolist()}
    assert set(zip(q.tolist(), c.tolist(), strict=True)) == want and np.array_equal(far, np.bitwise_count(codes[q] ^ codes[c]))


def test_gray_rank_orders_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(n ^ (n >> np.uint64(1))), n)


@pytest.mark.parametrize("kept,limit", [(2, 4096), (2, 16), (1, 16)])
def test_links_connect_what_all_pairs_connect(spark, kept, limit):
    codes = clustered(np.random.default_rng(7), 400)
    rows = spark.createDataFrame([(0, simhash.signed(int(x))) for x in codes], "tab int, fp long")
    at = {simhash.signed(int(x)): k for k, x in enumerate(codes)}
    links = [(at[r.a], at[r.b]) for r in simhash.fingerprint_links(rows, 2, kept, limit).collect()]
    assert all((int(codes[a]) ^ int(codes[b])).bit_count() <= 2 for a, b in links)
    every = [(a, b) for b in range(400) for a in range(b) if (int(codes[a]) ^ int(codes[b])).bit_count() <= 2]
    assert groups_of(400, links) == groups_of(400, every)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200, 260)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    root = groups_of(600, edges)
    assert got == {k: root[k] for e in edges if e[0] != e[1] for k in e}


def shingle5(text):
    w = WORD.findall(lower(text))
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def test_keep_one_against_all_pairs(spark):
    rng = random.Random(11)
    texts, near = [], []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // 80)):
                copy[at] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(copy))
        near.append(len(texts))
    texts += [texts[0], texts[0], "", None, " "]
    docs = spark.createDataFrame([(100 + k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    sets = [shingle5(t) for t in texts]
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / max(1, len(a | b))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    root = groups_of(len(texts), pairs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect()}
    want = {100 + r for r in root}
    assert want <= got and len(got - want) <= len(texts) * 0.01


def family(rng, core, spread):
    """Variants of one text: some keep all its words, some change a few."""
    base = [f"c{rng.randrange(5000)}" for _ in range(core)]
    out = []
    for _ in range(spread):
        copy = list(base)
        for at in rng.sample(range(core), rng.randint(1, max(1, core // 30))):
            copy[at] = f"v{rng.randrange(5000)}"
        if rng.random() < 0.4:
            at = rng.randrange(core - 20)
            block = copy[at : at + 20]
            rng.shuffle(block)
            copy[at : at + 20] = block
        out.append(copy)
    return out


def kept_and_wanted(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingle5(t) for t in texts]
    at: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    pairs = {(a, b) for own in at.values() for b in own for a in own if a < b}
    pairs = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups_of(len(texts), pairs)
    return {r.doc_id for r in simhash.keep_one(docs, **more).collect()}, set(root), root, pairs


def test_keep_one_on_texts_with_the_same_words(spark):
    """The first text has the words of the others in another order; they are alike, it isn't."""
    rng = random.Random(3)
    texts = []
    for _ in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        moved = [*base[:50], *base[55:], *base[50:55]]
        odd = [sorted(base), sorted(base, reverse=True)]
        texts += [" ".join(x) for x in (odd[0], base, moved, odd[1])]
    got, want, _, _ = kept_and_wanted(spark, texts)
    assert got == want and len(want) == 60


def test_keep_one_on_large_families(spark):
    rng = random.Random(4)
    texts = [" ".join(x) for core in (90, 150, 240) for x in family(rng, core, 200)]
    got, want, _, _ = kept_and_wanted(spark, texts)
    assert want <= got and len(got - want) <= len(texts) * 0.005


def test_large_buckets_in_tiles(spark):
    rng = random.Random(5)
    texts = [" ".join(x) for x in family(rng, 150, 120)]
    frame = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string")
    at = lambda **limits: groups_of(len(texts), [(int(r.a), int(r.b)) for r in simhash.similar_links(frame, **limits).collect()])
    assert at(node_limit=10) == at() == at(tile_shingles=2000, tile_work=50_000)


def test_tiles_weigh_shingles(spark):
    """Long texts make a bucket of few members heavy: every pair meets in one tile, and no tile is over its bounds by much."""
    members = [(f"{b}-{k}", b, n, n * each) for b, n, each in ((1, 300, 19_000), (2, 3_000, 200), (3, 40, 100), (4, 2, 0)) for k in range(n)]
    limits = {"node_limit": 1000, "tile_shingles": 500_000, "tile_work": 30_000_000}
    each = {1: 19_000, 2: 200, 3: 100, 4: 0}
    tiles, parts = {}, {}
    for r in simhash.in_tiles(spark.createDataFrame(members, "key string, band long, n long, weight long"), **limits).collect():
        tiles.setdefault((r.band, r.low, r.high), set()).add(r.key)
        parts.setdefault(r.band, {}).setdefault(r.key, []).append((r.low, r.high))
    for (band, _, _), keys in tiles.items():
        assert len(keys) <= 1.5 * limits["node_limit"] and len(keys) * each[band] <= 2 * limits["tile_shingles"] and len(keys) ** 2 * each[band] <= 4 * limits["tile_work"]
    for own in parts.values():
        keys = sorted(own)[:40]
        assert all(set(own[x]) & set(own[y]) for x in keys for y in keys)
    assert len(parts[3]) == 40 and {t for t in tiles if t[0] in (3, 4)} == {(3, 0, 0), (4, 0, 0)}


def test_verified_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    base = rng.choice(10**6, 60, replace=False)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 10**6, 60), base)).astype("<u4") for _ in range(80)] + [np.zeros(0, "<u4")] * 2
    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    pairs = [(a, b) for b in range(82) for a in range(b) if near(sets[a], sets[b])]
    links = simhash.verified_links(sets, 0.8)
    assert all(near(sets[a], sets[b]) for a, b in links) and groups_of(82, links) == groups_of(82, pairs)
    assert len(links) == 82 - len(set(groups_of(82, pairs)))


def test_keep_one_odd_rows(spark, messy, nothing):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and simhash.keep_one(nothing).count() == 0
    rows = kept.collect()
    texts = [r.text or "" for r in rows]
    assert len(set(texts)) == len(texts)
    assert len([t for t in texts if not t.strip()]) == 1


def plain_repeats(rows):
    """{(doc_id, text): (n_words, n_removed, kept)} of rows in order."""
    seen, out = set(), []
    for d, t in rows:
        w = WORD.findall(t or "")
        keys = [tuple(w[k : k + 20]) for k in range(len(w) - 19)]
        again = []
        for k, key in enumerate(keys):
            if key in seen:
                again.append(k)
            seen.add(key)
        gone = {j for k in again for j in range(k, k + 20)}
        out.append((d is None, d or 0, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("n_batches,max_runs", [(1, 1), (3, 1), (4, 2), (3, 9)])
def test_repeats_against_plain_windows(spark, tidy, n_batches, max_runs):
    rows = sorted(((r.doc_id, r.text) for r in tidy.collect()), key=lambda r: r[0])
    got = substrings.remove_repeats(tidy, n_batches, max_runs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == plain_repeats(rows)


def test_repeats_inside_a_document_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 40)
    rng = random.Random(8)
    passage, phrase = [f"p{k}" for k in range(33)], ["a", "b"]
    texts = []
    for k in range(60):
        own = [f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(own + passage[rng.randrange(4) :] * rng.randint(0, 2) + phrase * rng.randrange(30) + own[:10]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(docs, 2, 1).collect()
    assert sorted((False, r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain_repeats(list(enumerate(texts)))


def test_op6_odd_rows(spark, messy, nothing):
    import hashlib

    rows = sorted(((r.doc_id, r.text) for r in messy.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    got = substrings.op6(spark, messy).collect()
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest()) for r in plain_repeats(rows)]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert substrings.op6(spark, nothing).count() == 0


def test_op6_equals_its_sql(spark):
    import duckdb

    from galefold.llm.queries import OP6_SQL

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = substrings.op6(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(OP6_SQL).fetchall())


def edited(rng, words, kind, share):
    """A copy with about this share of the words changed in one way."""
    n = max(1, int(len(words) * share))
    if kind == "appended":
        return words + [f"n{rng.randrange(10**6)}" for _ in range(n)]
    if kind == "truncated":
        return words[:-n]
    if kind == "moved":
        at = rng.randrange(len(words) - n)
        rest = words[:at] + words[at + n :]
        to = rng.randrange(len(rest))
        return rest[:to] + words[at : at + n] + rest[to:]
    copy = list(words)
    for at in rng.sample(range(len(words)), max(1, n // 6)):
        copy[at] = f"n{rng.randrange(10**6)}"
    return copy


@pytest.mark.parametrize("kind", ["substituted", "appended", "truncated", "moved"])
def test_copies_of_each_kind_of_edit_share_a_key(kind):
    rng, hashes, found = random.Random(9), simhash.WordHashes(), []
    while len(found) < 600:
        words = [f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randint(60, 600))]
        a, b = (simhash.shingle_set([w.encode() for w in x], 5, hashes) for x in (words, edited(rng, words, kind, rng.uniform(0.02, 0.25))))
        both = len(np.intersect1d(a, b))
        if 0.8 <= both / (len(a) + len(b) - both) < 0.86:
            found.append((simhash.bands(a) == simhash.bands(b)).any())
    assert np.mean(found) >= 0.99


@pytest.mark.parametrize("kind", ["substituted", "appended", "truncated", "moved"])
def test_copies_of_each_kind_of_edit_are_near_in_a_table(kind):
    rng, hashes, found = random.Random(10), simhash.WordHashes(), []
    while len(found) < 600:
        words = [f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randint(60, 600))]
        a, b = (simhash.shingle_set([w.encode() for w in x], 5, hashes) for x in (words, edited(rng, words, kind, rng.uniform(0.02, 0.25))))
        both = len(np.intersect1d(a, b))
        if 0.8 <= both / (len(a) + len(b) - both) < 0.86:
            x, y = simhash.near_codes(a), simhash.near_codes(b)
            block = (simhash.bands(a) == simhash.bands(b)).reshape(len(x), simhash.BLOCKS).any(axis=1)
            found.append((block & (np.bitwise_count(x ^ y) <= simhash.NEAR)).any())
    assert np.mean(found) >= 0.995


def test_the_first_table_holds_simhashes():
    shingles = np.random.default_rng(1).integers(0, 2**32, 2500).astype("<u4")
    for own in (shingles, shingles[:1], shingles[:7], shingles[:0]):
        h = [int(x) for x in simhash.mixed(own.astype(np.uint64) + np.uint64(1))]
        assert int(simhash.near_codes(own)[0]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius,limit", [(10, 4096), (10, 20), (4, 60)])
def test_near_groups_connect_all_pairs_of_the_index(spark, radius, limit):
    """Of each table: pairs that agree on a block and are within the radius have a group in common, and groups hold nothing that they don't connect."""
    codes = [(t, int(x)) for t in (0, 1) for x in (*clustered(np.random.default_rng(t), 300).tolist(), *np.random.default_rng(5 + t).integers(0, 2**64, 300, dtype=np.uint64).tolist())]
    rows = spark.createDataFrame([(t, simhash.signed(x)) for t, x in codes], "tab int, fp long").repartition(3)
    at, groups = {(t, simhash.signed(x)): k for k, (t, x) in enumerate(codes)}, {}
    for r in simhash.near_groups(rows, radius, limit).collect():
        groups.setdefault(r.band, set()).add(at[r.tab, r.fp])
    alike = lambda a, b: a[0] == b[0] and (a[1] ^ b[1]).bit_count() <= radius and any((a[1] ^ b[1]) >> k & 0xFFFF == 0 for k in (0, 16, 32, 48))
    pairs = {(a, b) for b in range(len(codes)) for a in range(b) if alike(codes[a], codes[b])}
    own = [set() for _ in codes]
    for g, x in groups.items():
        assert len(x) > 1
        for k in x:
            own[k].add(g)
    assert len(pairs) > 1000 and all(own[a] & own[b] for a, b in pairs)
    for x in groups.values():
        inside = groups_of(len(codes), [(a, b) for a, b in pairs if a in x and b in x])
        assert len({inside[k] for k in x}) == 1


def test_a_hub_and_a_long_path_are_two_components(spark):
    rows = [("hub", f"leaf{k:05d}") for k in range(3000)] + [(f"p{k:04d}", f"p{k + 1:04d}") for k in range(200)] + [("x", "x"), ("y", None)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a string, b string").repartition(5)).collect()}
    assert len(found) == 3001 + 201 and {found[k] for k in found if k.startswith("p")} == {"p0000"} and {found[k] for k in found if not k.startswith("p")} == {"hub"}


def thue_morse():
    """Two words of 1,024 letters that polynomials modulo 2**64 give the same hash."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_built_to_collide_are_not_repeats(spark):
    one, other = thue_morse()
    rest = [f"w{k}" for k in range(19)]
    docs = [(1, " ".join([*rest, one])), (2, " ".join([*rest, other])), (3, " ".join([*rest, one]))]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_digests_follow_the_words():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    texts = [" ".join(words).encode(), " ".join(words[::-1]).encode(), " ".join(words).encode()]
    text = np.array([0, 0, 1, 2, 2])
    first, last = np.array([0, 5, 0, 0, 5]), np.array([3, 9, 3, 3, 9])
    found = [tuple(x) for x in substrings.digests(texts, text, first, last).tolist()]
    assert found[0] == found[3] and found[1] == found[4] and len(set(found)) == 3


def test_keep_one_on_words_built_to_collide(spark):
    one, other = thue_morse()
    docs = [(1, " ".join([one] * 5)), (2, " ".join([other] * 5))]
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).count() == 2
