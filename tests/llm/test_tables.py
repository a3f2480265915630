import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from galefold.llm import licenses, media, sharding

# -- sharding ----------------------------------------------------------------------------------


def check_shards(rows, docs, slack):
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in rows) == sorted(((d is None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    share = sum(load.values()) / 8
    assert all(abs(load[s] - share) <= slack for s in range(8))


@pytest.mark.parametrize("seed", [0, 1])
def test_op3_balance_and_groups(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 400))) for _ in range(500)]
    for k in range(60):
        texts += [texts[k]] * rng.randint(1, 6)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = sharding.op3(spark, frame).collect()
    check_shards(rows, docs, 2 * 401)
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32, r.size].add(r.shard)
    together = sum(len(h) == 1 for h in homes.values()) / len(homes)
    assert together > 0.97 and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_op3_one_group_of_more_than_a_shard(spark):
    rng = random.Random(4)
    texts = ["the same text again"] * 400 + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = list(enumerate(texts))
    rows = sharding.op3(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check_shards(rows, docs, 130)


def test_op3_odd_rows(spark, messy, nothing):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    rows = sharding.op3(spark, messy).collect()
    check_shards(rows, docs, 10**9)
    assert sharding.op3(spark, nothing).count() == 0


# -- licenses ----------------------------------------------------------------------------------


def test_templates_accept_options_and_wildcards():
    a = licenses.compile_template('begin <<beginOptional>>maybe <<var;name="x";most="2">> so<<endOptional>> end')
    ends = lambda t: a.match(t.encode().split(), 0)
    assert ends("begin end") == 2 and ends("begin maybe so end") == 4 and ends("begin maybe one two so end more") == 6
    assert ends("begin maybe one two three so end") is None and ends("begin other end") is None
    with pytest.raises(ValueError):
        licenses.compile_template("<<beginOptional>>x")


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", {"mit"}), ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}), ("Copyright 2020 some one. All rights reserved.", {"reserved", "all-rights-reserved"}), ("under the Apache License, Version 3.0", set()), ("ALL  Rights-Reserved", {"reserved", "all-rights-reserved"}), ("all rights are reserved", set()),
])
def test_labels(text, labels):
    assert {f[1] for f in licenses.Scanner().scan("before " + text + " after")[1]} == labels


def plain_base(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_op7_against_plain_search(spark, messy, nothing):
    rng = random.Random(7)
    bits = ["CC BY", "cc\nby", "general public license", "General-Public", "license", "all rights reserved", "All rights reserved cc by", "ß", "x", "Ä", "4.0", "cc_by", "K"]
    more = spark.createDataFrame([(1000 + k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for k in range(300)], "doc_id long, text string")
    docs = messy.select("doc_id", "text").unionByName(more)
    want = sorted((r.doc_id is None, r.doc_id or 0, *map(str, plain_base(r.text))) for r in docs.collect())
    rows = licenses.op7(spark, docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert licenses.op7(spark, nothing).count() == 0


# -- media -------------------------------------------------------------------------------------


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, bytes(range(256)) * 9 + b"!"])
def test_png_round_trip(data):
    payload = media.padded(data)
    png = media.to_png(payload)
    assert payload.startswith(data) and len(payload) % 64 == 0 and payload and media.from_png(png) == payload
    with pytest.raises(ValueError):
        media.from_png(png[:45] + bytes([png[45] ^ 1]) + png[46:])


def test_png_is_one_that_others_read():
    plt = pytest.importorskip("PIL.Image")
    import io

    payload = bytes(range(128))
    assert plt.open(io.BytesIO(media.to_png(payload))).tobytes() == payload


def test_op8_against_plain_computation(spark, messy, nothing):
    rows = media.op8(spark, messy).collect()

    def plain(text):
        data = (text or "").encode()
        p = media.padded(data)
        return len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media.to_png(p)), hashlib.sha256(media.to_png(p)).hexdigest(), media.feature(p)

    want = sorted((r.doc_id is None, r.doc_id or 0, *plain(r.text)) for r in messy.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows) == want
    assert media.op8(spark, nothing).count() == 0


HTML = """<html><head><title>no</title><style>p{}</style></head><body><h1>Title</h1><p>One &amp; two<br>three <b>four</b></p><script>var x = "<p>";</script>
<figure><img src="sha256:{0}"><figcaption>A <i>caption</i></figcaption></figure>text between<img src="other.png" alt="alt text"><p>end"""


def test_sequences_keep_order_captions_and_payloads(spark):
    digest = hashlib.sha256(media.padded(b"payload")).hexdigest()
    store = media.store_media(spark.createDataFrame([(digest, b"payload")], "digest string, data binary"))
    pages = spark.createDataFrame([(1, HTML.replace("{0}", digest), "u"), (2, None, "v")], "page_id long, html string, url string")
    rows = media.resolve(media.interleave(pages), media.read_features(store)).orderBy("position").collect()
    assert [(r.kind, r.text or r.ref, r.caption) for r in rows] == [
        ("text", "Title", None), ("text", "One & two", None), ("text", "three four", None), ("media", f"sha256:{digest}", "A caption"), ("text", "text between", None), ("media", "other.png", "alt text"), ("text", "end", None),
    ]
    assert [r.payload_sha256 for r in rows if r.kind == "media"] == [digest, None] and {r.url for r in rows} == {"u"}


def test_given_pages_parse(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = media.interleave(pages)
    assert out.count() == pages.count() and out.where(F.exists("sequence", lambda p: p["text"].contains("track("))).count() == 0
