"""Whole license templates and interleaved sequences."""

import hashlib
import html
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from galefold.llm import licenses, media


def filled(markup, options, rng):
    """A text that a template accepts: optional regions kept or left out, variables filled with other words."""
    out, skip = [], 0
    for k, part in enumerate(licenses._MARK.split(markup)):
        if k % 2 == 0:
            out += [] if skip else part.split()
        elif part == "beginOptional":
            skip += 0 if options and not skip else 1
        elif part == "endOptional":
            skip = max(0, skip - 1)
        elif not skip:
            out += [f"name{rng.randrange(99)}" for _ in range(rng.randint(1, 2))]
    return out


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_positive_altered_truncated(label):
    rng, scanner = random.Random(3), licenses.Scanner()
    labels = lambda words: {f[1] for f in scanner.scan(" ".join(["before", *words, "after"]))[1] if f[0] == "template"}
    for markup in licenses.TEMPLATES[label]:
        for options in (True, False):
            words = filled(markup, options, rng)
            assert label in labels([w.upper() if k % 3 else w + "," for k, w in enumerate(words)])
        needed = re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<var[^>]*>>", " ", markup).split()
        at = len(words) - 1 - words[::-1].index(needed[-1])
        assert label not in labels(words[:at])  # truncated
        middle = words.index(needed[len(needed) // 2])
        assert label not in labels([*words[:middle], "otherwise", *words[middle + 1 :]])  # altered


def test_enough_labels():
    assert len(licenses.TEMPLATES) >= 20 and sum(len(max(own, key=len).split()) > 30 for own in licenses.TEMPLATES.values()) >= 12


def messy_html(rng):
    """HTML with marks left open at random, the words that must be kept, and its media."""
    words, refs, out, n = [], [], ["<html><head><title>gone</title><style>gone{}</style>" + rng.choice(["</head>", ""]) + rng.choice(["<body>", ""])], 0

    def some():
        nonlocal n
        own = [f"w{n + k}x" for k in range(rng.randint(1, 3))]
        n += 3
        words.extend(own)
        return " ".join(own)

    for _ in range(rng.randint(3, 14)):
        kind = rng.randrange(6)
        if kind == 0:
            out.append(f"<p>{some()}" + rng.choice(["</p>", "", "<br>"]))
        elif kind == 1:
            ref = f"m{n}.png"
            refs.append(ref)
            out.append(rng.choice([f'<img src="{ref}">', f'<img data-src="{ref}" alt="a">', f'<img srcset="small.png 1x, {ref} 2x">']))
        elif kind == 2:
            ref = f"f{n}.png"
            refs.append(ref)
            out.append(f'<figure><img src="{ref}"><figcaption>{some()}' + rng.choice(["</figcaption></figure>", "</figure>", ""]))
        elif kind == 3:
            out.append(f"<figcaption>{some()}</figcaption>")
        elif kind == 4:
            out.append("<script>gone('<p>')</script>")
        else:
            out.append(f"<div>{some()}<b>{some()}")
    return "".join(out), words, refs


def test_no_text_and_no_media_is_lost():
    rng = random.Random(17)
    for _ in range(300):
        page, words, refs = messy_html(rng)
        parts = media.parse(page)
        got = [w for p in parts for w in re.findall(r"w\d+x", (p["text"] or "") + " " + (p["caption"] or ""))]
        assert set(got) == set(words) and [p["ref"] for p in parts if p["kind"] == "media"] == refs and "gone" not in str(parts)


def test_addresses_resolve_and_names_clash(spark):
    digest = hashlib.sha256(media.padded(b"x")).hexdigest()
    features = media.read_features(media.store_media(spark.createDataFrame([(digest, b"x")], "digest string, data binary")))
    pages = spark.createDataFrame([(1, '<p>one<img src="/a.png">two<img src="b.png">', "http://h.example/d/p", 5, "t", 2)], "page_id long, html string, url string, position int, text string, digest int")
    known = spark.createDataFrame([("http://h.example/a.png", digest)], "url string, digest string")
    rows = media.resolve(media.interleave(pages, "url"), features, known).orderBy("position").collect()
    assert [(r.position, r.text or r.ref, r.payload_sha256) for r in rows] == [(0, "one", None), (1, "http://h.example/a.png", digest), (2, "two", None), (3, "http://h.example/d/b.png", None)]
    assert {r.page_id for r in rows} == {1}


def test_op8_sequences_hold_the_whole_document(spark, messy):
    texts = {(r.doc_id, r.text) for r in messy.collect()}
    got = {(r.doc_id, r.words_crc32, r.caption) for r in media.op8(spark, messy).collect()}
    assert got == {(d, zlib.crc32(" ".join((t or "").split()).encode()), f"document {'without id' if d is None else d}") for d, t in texts}


def test_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("raw", F.col("html"))
    for r in media.interleave(pages).select("raw", F.transform("sequence", lambda p: p["text"]).alias("texts")).collect():
        plain = re.sub(r"<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->", " ", r.raw, flags=re.S)
        plain = re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?(b|a)\b", m[0]) else " ", plain)
        assert " ".join(r.texts).split() == html.unescape(plain).split()
