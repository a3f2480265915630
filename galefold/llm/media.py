"""Operator 8: media columns as interleaved document sequences.

`interleave` parses HTML into an ordered array of structs, text runs and references to
media with their captions; `resolve` joins the references with a media store by the
payload's digest (`sha256:...`, or found by a table of URLs), and each part keeps its
position, so that text, media and captions stay aligned.

The store keeps each payload losslessly as an 8-bit grey PNG, WIDTH samples a row. Its
rows are written where their texts are read and read back for features there; only
digests and features are shuffled, never payloads or text parts. A payload that many
documents share is joined as one small row, and Spark may split the documents' side.

The query makes a page of each document, its lines as paragraphs and its payload as a
figure behind the first of them, and parses, resolves and measures these whole sequences.

Defined results: a null text or page counts as empty; an empty payload is one row of
zeros; a reference that the store lacks keeps its place with null features; a caption ends
with its figure, and one without media is text; text outside of scripts, styles, titles,
templates and noscript is never lost, whatever marks are left open; repeated rows give
repeated results; other columns stay, but for those that have the name of a column of the
result, which go; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, saved, whole_texts

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img", "video", "audio", "source"}
_SILENT = {"script", "style", "template", "noscript", "title"}
_BREAKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "br", "figure", "nav", "header", "footer", "blockquote", "pre"}


# -- stored form -------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as to_png makes it; any damage is an error."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if size[2:] != (8, 0, 0, 0, 0) or rows[:, 0].any():
        raise ValueError("another kind of PNG")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy (bits) of the samples, the mean step between neighbours, and a hash of 8 x 8 block means."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    rows = x.reshape(-1, WIDTH).astype(np.float64)
    blocks = np.stack([b.mean(axis=0).reshape(8, -1).mean(axis=1) for b in np.array_split(rows, 8) if len(b)])
    bits = np.packbits(blocks > blocks.mean()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};step={np.abs(np.diff(x.astype(np.int16))).mean():.4f};blocks={bits}"


def store_media(payloads: DataFrame) -> DataFrame:
    """Write (digest, media) for rows of (digest, data): a task writes each digest once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        for batch in batches(rows):
            out = []
            for digest, data in zip(batch["digest"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if digest not in done:
                    done.add(digest)
                    out.append((digest, to_png(padded(data))))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.string()), pa.array([m for _, m in out], pa.binary())], names=["digest", "media"])

    return saved(payloads.select("digest", "data").mapInArrow(run, "digest string, media binary"), "media")


_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(store: DataFrame) -> DataFrame:
    """A row for each digest, from the stored bytes alone."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for digest, media in zip(batch["digest"].to_pylist(), batch["media"].to_pylist(), strict=True):
                payload = from_png(media)
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _FEATURES.split(", ")])

    return store.mapInArrow(run, _FEATURES).distinct()


# -- sequences ---------------------------------------------------------------------------------


def reference(attrs: dict) -> str | None:
    """Where a media element leads: src, else a lazy one's data-src, else the last address of srcset."""
    sets = [x.split()[0] for x in (attrs.get("srcset") or attrs.get("data-srcset") or "").split(",") if x.split()]
    return attrs.get("src") or attrs.get("data-src") or (sets[-1] if sets else None)


class _Parser(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.parts, self.text, self.silent, self.caption, self.figure, self.captioned = base, [], [], [], None, None, set()

    def _part(self, kind: str, text: str | None, ref: str | None, caption: str | None) -> None:
        self.parts.append({"kind": kind, "text": text, "ref": ref, "caption": caption})

    def close_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self._part("text", text, None, None)

    def close_caption(self) -> None:
        if self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            own = [p for p in self.parts[self.figure :] if p["kind"] == "media"] if self.figure is not None else []
            for part in own if caption else ():  # takes the place of an alt text, and follows an earlier caption
                part["caption"] = f"{part['caption']} {caption}" if id(part) in self.captioned else caption
                self.captioned.add(id(part))
            if caption and not own:
                self._part("text", caption, None, None)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in _SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in _BREAKS or tag in _MEDIA or tag == "figcaption":
            self.close_text()
        if tag in ("figure", "figcaption"):
            self.close_caption()
        if tag == "figure":
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and (ref := reference(attrs)):
            self._part("media", None, urljoin(self.base, ref) if self.base and not ref.startswith("sha256:") else ref, attrs.get("alt") or None)

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent and self.silent.pop() != tag:
                pass
        if tag in _BREAKS:
            self.close_text()
        if tag in ("figure", "figcaption"):
            self.close_caption()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str, base: str | None = None) -> list[dict]:
    """Ordered parts: {kind: text | media, text, ref, caption}. A reference is taken as relative to base, if there is one."""
    p = _Parser(base)
    p.feed(html)
    p.close()
    p.close_text()
    p.close_caption()
    return p.parts


_SEQUENCE = "array<struct<kind:string,text:string,ref:string,caption:string>>"


def interleave(pages: DataFrame, base: str | None = None) -> DataFrame:
    """pages (html, ...) with `sequence`: array of structs in the order of the page. base: a column of addresses. Other columns stay."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("html", "sequence")]
    rows = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), (F.col(f"`{base}`").cast("string") if base else F.lit(None).cast("string")).alias("sequence"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_):
            parsed = [parse(h, b) for h, b in zip(batch["html"].to_pylist(), batch["sequence"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(parsed, kind)], names=[*(f.name for f in kept), "sequence"])

    return rows.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"sequence {_SEQUENCE}")


def resolve(sequences: DataFrame, features: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """A row for each part: the other columns, position, kind, text, ref, caption, digest and, for media, the store's features.

    addresses (url, digest, each url once): what references that are no digests lead to.
    """
    made = {"sequence", "position", "kind", "text", "ref", "caption", *(c.lower() for c in features.columns)}
    others = [F.col(f"`{c}`") for c in sequences.columns if c.lower() not in made]
    parts = sequences.select(*others, F.posexplode("sequence").alias("position", "part")).select(*others, "position", "part.*")
    found = features.columns
    texts = parts.where("kind = 'text'").select("*", *(F.lit(None).cast(features.schema[c].dataType).alias(c) for c in found))
    media = parts.where("kind = 'media'").withColumn("digest", F.nullif(F.regexp_extract("ref", r"^sha256:([0-9a-f]{64})$", 1), F.lit("")))
    if addresses is not None:
        known = addresses.select(F.col("url").alias("ref"), F.col("digest").alias("digest_of_url"))
        media = media.join(known, "ref", "left").withColumn("digest", F.coalesce("digest", "digest_of_url")).drop("digest_of_url")
    media = media.join(features, "digest", "left").select(*texts.columns)
    return texts.unionByName(media)


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """HTML of a document: a paragraph for each line, and a figure with its payload behind the first."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.substr(safe, F.length(first) + 2)
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>"))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    texts = whole_texts(docs)
    n = F.octet_length("text").cast("long")
    zeros = F.pmod(-n, F.lit(WIDTH)) + F.when(n == 0, F.lit(WIDTH)).otherwise(F.lit(0))
    payload = F.concat(F.encode("text", "UTF-8"), F.unhex(F.repeat(F.lit("00"), zeros.cast("int"))))
    own = texts.select("doc_id", n.alias("n_bytes"), F.sha2(payload, 256).alias("digest"), "text")
    features = saved(read_features(store_media(own.select("digest", F.encode("text", "UTF-8").alias("data")))), "media-features")
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))
    sequences = interleave(own.select("doc_id", "n_bytes", as_page(F.col("text"), F.col("digest"), caption).alias("html")))
    words = F.concat_ws(" ", F.transform(F.filter("sequence", lambda x: x["kind"] == "text"), lambda x: x["text"]))
    sequences = sequences.select("doc_id", "n_bytes", F.size("sequence").alias("n_parts"), F.crc32(words).alias("words_crc32"), "sequence")
    # Only media parts are asked for; text parts have been summed up where they were parsed.
    parts = resolve(sequences, features).where("kind = 'media'")
    return parts.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_parts", "words_crc32")
