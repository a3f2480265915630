"""Operator 11: phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words
`[^\\x20\\x09]+`; phrases lie within a piece, and all counts are per language (null: `und`).

1. Counts. Prefix polynomials over the bytes give every word's hash, and over these every
   phrase's fingerprint. A task adds up equal fingerprints, a shuffle those of all tasks.
   Words and pairs come first; of three and four words only those are counted whose two
   parts of one word less may be frequent, by a Bloom filter, which spares rows and decides
   nothing. A fingerprint that reaches `least` is frequent; since phrases can collide, its
   sum is an upper bound of each one's count.
2. Places. The phrases of frequent fingerprints are met once more. In a block of texts, equal
   fingerprints are compared by their words, and each different phrase gives one row: a
   128-bit digest of its words, its count, a pointer to one place, in the block's longest text
   that has it. A shuffle adds up the rows of each digest and keeps one pointer.
3. Texts. Only those pointers are followed whose phrase really is frequent, so that only
   frequent phrases ever become text; the words at each are held against the digest.

Scores come from joins over the frequent phrases alone: every part of a frequent phrase is
frequent.

Defined results: null and empty texts have no words; a null language counts as `und`;
repeated rows and ids count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batches, bloom, drop, maybe, parted, saved
from .substrings import numbered
from .words import _BYTES, inverse, ladder, mixed

LONGEST = 4
LEAST = 30
#: Bytes of text that a task takes at once, fingerprints that it adds up at once, bytes that are hashed at once, bytes from which a word is hashed by XXH64.
BLOCK, COUNTED, CHUNK, LONG_WORD = 3 << 20, 2_000_000, 1 << 16, 32
#: Candidates that one task of the first ranking has.
RANKED = 50_000
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_GAP = np.isin(np.arange(256), [0x20, 0x09])
_CUT = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
PLACES = "high long, low long, n long, doc long, start int, stop int"


class Block(NamedTuple):
    """The words of some texts: their bytes (lower-cased), where each begins and ends, its piece, its text and each text's place."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    first: np.ndarray


def block_of(texts: list[bytes]) -> Block:
    data = _LOWER[np.frombuffer(b"\n".join([*texts, bytes(8)]), np.uint8)]  # eight bytes more, so that eight can be read from every place
    apart = _GAP[data] | _CUT[data]
    apart[-9:] = True
    edge = np.diff(np.concatenate([[True], apart]).view(np.int8))
    begin, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    return Block(data, begin, end, np.cumsum(_CUT[data], dtype=np.int32)[begin], np.searchsorted(first, begin, side="right") - 1, first)


def word_hashes(b: Block) -> np.ndarray:
    """64-bit hashes of all words: polynomials of their bytes, from sums over the bytes before; XXH64 for long words."""
    import xxhash

    out, size = np.zeros(len(b.begin), np.uint64), b.end - b.begin
    up, down = ladder(_BASE, CHUNK + LONG_WORD), ladder(inverse(_BASE), CHUNK + LONG_WORD)
    short = np.nonzero(size < LONG_WORD)[0]
    bounds = np.searchsorted(b.begin[short], np.arange(0, len(b.data) + CHUNK, CHUNK))
    for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own, part = short[low:high], b.data[k * CHUNK : (k + 1) * CHUNK + LONG_WORD]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[0][part] * up[: len(part)], out=total[1:])
        x, y = b.begin[own] - k * CHUNK, b.end[own] - k * CHUNK
        out[own] = (total[y] - total[x]) * down[x]
    for k in np.nonzero(size >= LONG_WORD)[0]:
        out[k] = xxhash.xxh64_intdigest(b.data[b.begin[k] : b.end[k]].tobytes())
    return mixed(out + size.astype(np.uint64))


def exact_words(b: Block, h: np.ndarray) -> np.ndarray:
    """A number for each word that equal words share and others don't: by hash, and by comparison of the bytes of equal hashes."""
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
    out = np.zeros(len(h), np.int64)
    out[order] = order[np.nonzero(new)[0]][np.cumsum(new) - 1]
    size = b.end - b.begin
    alike = size == size[out]
    eight = np.ndarray((len(b.data) - 7,), "<u8", b.data, strides=(1,))
    left = np.nonzero(alike & (out != np.arange(len(h))))[0]
    for at in range(0, LONG_WORD, 8):
        left = left[size[left] > at]
        keep = np.minimum(size[left] - at, 8).astype(np.uint64) * np.uint64(8)
        shift = np.uint64(64) - keep
        same = (eight[b.begin[left] + at] ^ eight[b.begin[out[left]] + at]) << shift == 0
        alike[left[~same]] = False
        left = left[same]
    for k in left[size[left] > LONG_WORD]:
        alike[k] = np.array_equal(b.data[b.begin[k] : b.end[k]], b.data[b.begin[out[k]] : b.end[out[k]]])
    other: dict[bytes, int] = {}
    for k in np.nonzero(~alike)[0]:
        out[k] = other.setdefault(b.data[b.begin[k] : b.end[k]].tobytes(), k)
    return out


def fingerprints(h: np.ndarray, n: int, lang: np.ndarray, bits: int) -> np.ndarray:
    """Of the n words from each place on, in the language of its first one, as far as there are n."""
    up, down = ladder(_WORD_BASE, len(h) + 1), ladder(inverse(_WORD_BASE), len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    m = max(0, len(h) - n + 1)
    found = mixed(mixed((total[n : n + m] - total[:m]) * down[:m] + np.uint64(n)) + lang[:m])
    return found >> np.uint64(64 - bits)


class Phrases(NamedTuple):
    """A block's words with their hashes, the languages of its texts, and each word's language (its number and hash)."""

    block: Block
    hashes: np.ndarray
    langs: list[str]
    lang: np.ndarray
    lang_hash: np.ndarray

    def fingerprints(self, n: int, bits: int) -> np.ndarray:
        return fingerprints(self.hashes, n, self.lang_hash, bits)

    def places(self, n: int) -> np.ndarray:
        """Which words begin a phrase of n words."""
        m, piece = max(0, len(self.hashes) - n + 1), self.block.piece
        return piece[:m] == piece[len(piece) - m :]


def phrases_of(langs: list[str], texts: list[bytes]) -> Phrases:
    import xxhash

    b = block_of(texts)
    names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([names[x] for x in langs], np.int64)[b.text]
    return Phrases(b, word_hashes(b), list(names), lang, np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], np.uint64)[lang])


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], list[bytes]]]:
    docs, langs, texts, size = [], [], [], 0
    for batch in batches(rows):
        docs += batch["doc"].to_pylist()
        langs += batch["lang"].to_pylist()
        texts += as_bytes(batch["text"])
        size += batch["text"].nbytes
        if size >= BLOCK:
            yield docs, langs, texts
            docs, langs, texts, size = [], [], [], 0
    if texts:
        yield docs, langs, texts


def _summed(fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fp)
    fp, n = fp[order], n[order]
    first = np.nonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))[0] if len(fp) else np.zeros(0, np.int64)
    return fp[first], np.add.reduceat(n, first) if len(fp) else n


def _counts(lengths: list[int], among, bits: int):
    """Fingerprints of phrases of these lengths and how often a task meets them. among: a filter of the fingerprints of one word less."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, ns, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if fps:
                fp, n = _summed(np.concatenate(fps), np.concatenate(ns))
                for at in range(0, len(fp), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[at : at + 200_000].view(np.int64)), pa.array(n[at : at + 200_000])], names=["fp", "n"])

        for _, langs, texts in _blocks(rows):
            x = phrases_of(langs, texts)
            for n in lengths:
                fp, inside = x.fingerprints(n, bits), x.places(n)
                if among is not None:
                    part = maybe(among.value, x.fingerprints(n - 1, bits))
                    inside &= part[: len(fp)] & part[1 : len(fp) + 1]
                fp, count = _summed(fp[inside], np.ones(inside.sum(), np.int64))
                fps.append(fp)
                ns.append(count)
                held += len(fp)
            if held >= COUNTED:
                yield from out()
                fps, ns, held = [], [], 0
        yield from out()

    return run


def digest(lang: bytes, words: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(lang + b"\n" + words)


def plain_words(piece: bytes) -> bytes:
    """The words of a lower-cased piece, with one blank between them."""
    return b" ".join([w for w in piece.replace(b"\t", b" ").split(b" ") if w])


def _places(longest: int, among, bits: int):
    """A row for each different phrase in a block whose fingerprint may be frequent, and one for the empty phrase of each language."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, langs, texts in _blocks(rows):
            order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
            docs = np.array([docs[k] for k in order], np.int64)
            x = phrases_of([langs[k] for k in order], [texts[k] for k in order])
            b, data, names, words = x.block, x.block.data.tobytes(), [s.encode() for s in x.langs], exact_words(x.block, x.hashes)
            for n in range(longest + 1):
                if n:
                    fp = x.fingerprints(n, bits)
                    at = np.nonzero(x.places(n))[0]
                    at = at[maybe(among.value, fp[at])]
                    at = at[np.argsort(fp[at], kind="stable")]
                    new = np.concatenate([[True], fp[at][1:] != fp[at][:-1]]) if len(at) else np.zeros(0, bool)
                    group = np.cumsum(new) - 1
                    first = at[np.nonzero(new)[0]][group]
                    alike = x.lang[at] == x.lang[first]
                    for k in range(n):
                        alike &= words[at + k] == words[first + k]
                    # A phrase that isn't its fingerprint's first goes place by place.
                    place = np.concatenate([at[new], at[~alike]])
                    count = np.concatenate([np.bincount(group, alike, int(new.sum())).astype(np.int64), np.ones((~alike).sum(), np.int64)])
                    start, stop = b.begin[place], b.end[place + n - 1]
                else:
                    place = np.unique(x.lang, return_index=True)[1]
                    count = np.bincount(x.lang)[x.lang[place]] if len(place) else np.zeros(0, np.int64)
                    start = stop = b.first[b.text[place]]
                marks = [digest(names[k], plain_words(data[i:j])) for k, i, j in zip(x.lang[place].tolist(), start.tolist(), stop.tolist(), strict=True)]
                marks = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                text = b.text[place]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (marks[:, 0].copy(), marks[:, 1].copy(), count, docs[text], (start - b.first[text]).astype(np.int32), (stop - b.first[text]).astype(np.int32))], names=[c.split()[0] for c in PLACES.split(", ")])

    return run


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words at each pointer, which must have their digest."""
    lower = bytes(_LOWER)
    for batch in batches(rows):
        langs, phrases, counts = [], [], []
        for lang, text, own in zip(batch["lang"].to_pylist(), as_bytes(batch["text"]), batch["own"], strict=True):
            own = own.values
            for high, low, n, start, stop in zip(*(own.field(c).to_pylist() for c in ("high", "low", "n", "start", "stop")), strict=True):
                words = plain_words(text[start:stop].translate(lower))
                if np.array([high, low]).tobytes() != digest(lang.encode(), words):
                    raise ValueError("a pointer leads to other words; did the documents change meanwhile?")
                langs.append(lang)
                phrases.append(words)
                counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = 64) -> DataFrame:
    """Per language the phrases of up to `longest` words that stand `least` times or more: lang, phrase, f; the empty phrase has the number of words.

    bits: of a fingerprint; fewer make more collisions, and the same result.
    """
    spark = docs.sparkSession
    texts = numbered(docs, F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    written, among = [], None
    for lengths in [[1, 2], *([n] for n in range(3, longest + 1))]:
        counts = texts.select("doc", "lang", "text").mapInArrow(_counts(lengths, among, bits), "fp long, n long")
        frequent = saved(counts.groupBy("fp").agg(F.sum("n").alias("total")).where(F.col("total") >= least).select("fp"), "frequent")
        written.append(frequent)
        among = spark.sparkContext.broadcast(bloom(frequent, "fp"))
    every = written[0]
    for more in written[1:]:
        every = every.unionByName(more)
    places = texts.select("doc", "lang", "text").mapInArrow(_places(longest, spark.sparkContext.broadcast(bloom(every, "fp")), bits), PLACES)
    found = places.groupBy("high", "low").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("doc", "start", "stop")))
    found = saved(found.where(F.col("n") >= least).select("high", "low", "n", "doc", "start", "stop"), "pointers")
    own = saved(found.groupBy("doc").agg(F.collect_list(F.struct("high", "low", "n", "start", "stop")).alias("own")), "own")
    fetched = parted(texts, own, "doc")[1].join(own, "doc").select("lang", "text", "own")
    out = saved(fetched.mapInArrow(_texts, "lang string, phrase string, f long"), "phrases")
    drop(found, own, *written)
    return out


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (phrases of two words or more) with the l, r and score of the cut that scores least: lang, phrase, a, l, r, score."""
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", words.alias("w"), F.col("f").alias("a")).where(F.size("w") > 1)
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = F.array(F.struct(F.lit(True).alias("is_left"), _joined(F.col("w"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("is_left"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("part")))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.is_left", "s.part")
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    rows = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def outside(candidates: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one holds with `share` percent of their count or more."""
    words = F.split("phrase", " ")
    longer = phrases.select("lang", words.alias("w"), "f").where(F.size("w") > 2)
    spans = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    inside = longer.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    held = F.coalesce(F.col("most").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * share, F.lit(False))
    return candidates.join(inside, ["lang", "phrase"], "left").where(~held).drop("most")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = 80, top: int = 2000, bits: int = 64) -> DataFrame:
    """Each language's first `top` phrases by score, count and bytes: lang, rank, phrase, a, l, r, n, score."""
    phrases = frequent_phrases(docs, longest, least, bits)
    total = phrases.where("phrase = ''").select("lang", F.col("f").alias("n"))
    phrases = phrases.where("phrase <> ''")
    found = saved(outside(scored(phrases), phrases, share), "candidates")
    # The first of each of some parts of a language, then the first of these: no task ranks all candidates of a language.
    parts = found.count() // RANKED + 1
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return collocations(docs, longest=4, least=30, share=80, top=2000)
