"""Operator 12: chat formatting by typed content parts.

A turn's content is a list of parts: text, image, audio, document. A visitor flattens them,
in order, into the turn's body: text is escaped, every other part becomes a placeholder
and is recorded as an attachment (kind, reference, place in the body, the tokens that the
placeholder stands for, its own source). Plain texts are cut into parts where they hold
media markup: `![caption](ref)`, `<audio src="ref">`, `<document src="ref">`; sizes may stand
in the markup (`width`, `height`, `seconds`, `pages`).

The template marks turns by control strings, which texts can't hold: a backslash goes
between the first and the second character of each one that stands in a text, and
backslashes are doubled. Both are undone when the output is read. The loss mask is a list of
spans of code points: the bodies of assistant turns.

Turns are flattened where they lie. Then they are dealt out by ranges of conversation
and turn, so that a long conversation may lie in several tasks, and joined to segments of at
most SEGMENT characters (or one turn). A conversation's output is its segments in order.
Reading back undoes the parts and escapes segment by segment; only the digests, which
take a conversation's characters one after the other, need its segments in one task, as a
stream.

Defined results: a null text or list of parts is empty, a null role is the role ""; rows
without a conv_id are one conversation, with a null conv_id; turns that repeat a number, or have
none (they come first), are ordered by role and text, and repeated rows are as many turns; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, saved, short_batches

SEGMENT = 1_000_000
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
#: What comes before and after a body; other roles are named.
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "</s>")}
OTHER = ("[ROLE] ", "[:] ", " [/ROLE]")
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[:]", "[/ROLE]", *PLACEHOLDERS.values()]
#: Parts of a user's own: type is text, image, audio or document.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<kind: string, ref: string, at: long, tokens: long, source: string>"
MEDIA = re.compile(r'!\[[^\]\n]*\]\((?P<image>[^()\s]+)[^()\n]*\)|<audio src="(?P<audio>[^"\n]*)"[^<>\n]*>|<document src="(?P<document>[^"\n]*)"[^<>\n]*>')
_SIZES = re.compile(r'\b(width|height|seconds|pages)="?([0-9]{1,6}(?:\.[0-9]{1,6})?)')
_ESCAPED = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_TURN = re.compile("|".join(re.escape(a) + "(.*?)" + re.escape(b) for a, b in (TURNS["user"], TURNS["system"])) + "|" + re.escape(OTHER[0]) + "(.*?)" + re.escape(OTHER[1]) + "(.*?)" + re.escape(OTHER[2]) + "|(.*?)" + re.escape(TURNS["assistant"][1]), re.DOTALL)


class Expansion(NamedTuple):
    """Tokens that a placeholder stands for: an image's patches (of so many pixels a side), so many a second of audio, so many a page."""

    patch: int = 14
    image: int = 576
    second: float = 25.0
    audio: int = 750
    page: int = 512

    def tokens(self, kind: str, width=None, height=None, seconds=None, pages=None) -> int:
        if kind == "image":
            return math.ceil(width / self.patch) * math.ceil(height / self.patch) if width and height else self.image
        if kind == "audio":
            return math.ceil(seconds * self.second) if seconds else self.audio
        return self.page * max(1, int(pages or 1))


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Flattener:
    """The visitor: takes a turn's parts in order and keeps the body's pieces and the attachments."""

    def __init__(self, expansion: Expansion = Expansion()):
        self.expansion, self.pieces, self.attachments, self.length = expansion, [], [], 0

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        kind = part["type"] or "text"
        if kind not in ("text", *PLACEHOLDERS):
            raise ValueError(f"no part of type {kind!r}: text, image, audio and document are known")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, width=part.get("width"), height=part.get("height"))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, seconds=part.get("seconds"))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, pages=part.get("pages"))

    def _attach(self, kind: str, part: dict, **size) -> None:
        source = part.get("text") if part.get("text") is not None else part["ref"] or ""
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.length, "tokens": self.expansion.tokens(kind, **size), "source": source})
        self._put(PLACEHOLDERS[kind])


def parts_of(text: str) -> list[dict]:
    """A plain text as parts: media markup becomes parts whose `text` is the markup itself, so that nothing is lost."""
    out, at = [], 0
    for m in MEDIA.finditer(text) if "](" in text or ' src="' in text else ():
        out.append({"type": "text", "text": text[at : m.start()]})
        sizes = {k: float(x) for k, x in _SIZES.findall(m[0])}
        out.append({"type": m.lastgroup, "text": m[0], "ref": m[m.lastgroup], **sizes})
        at = m.end()
    return [*out, {"type": "text", "text": text[at:]}]


def _flat(expansion: Expansion, parts: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            bodies, attached = [], []
            for content in batch["content"].to_pylist():
                visitor = Flattener(expansion)
                for part in (content or []) if parts else parts_of(content):
                    visitor.visit(part)
                bodies.append("".join(visitor.pieces))
                attached.append(visitor.attachments)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64()), ("source", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], batch["tie"], pa.array(bodies, pa.string()), pa.array(attached, kind)], names=["conv_id", "turn", "role", "tie", "body", "attachments"])

    return run


def flattened(rows: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """Per row (conv_id, turn, role and parts: array of PART, or text): conv_id, turn, role, tie, body, attachments."""
    short_batches(rows.sparkSession)
    parts = "parts" in rows.columns
    content = F.col("parts").cast(f"array<{PART}>") if parts else F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.md5(F.to_json(F.struct(content.alias("c"))))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), tie.alias("tie"), content.alias("content"))
    return turns.mapInArrow(_flat(expansion, parts), f"conv_id long, turn long, role string, tie string, body string, attachments array<{ATTACHMENT}>")


def around(role: str) -> tuple[str, str]:
    if role in TURNS:
        return TURNS[role]
    return OTHER[0] + escape(role) + OTHER[1], OTHER[2]


FORMATTED = f"conv_id long, turn long, role string, tie string, segment int, formatted string, loss array<struct<start: long, stop: long>>, attachments array<{ATTACHMENT}>"


def _joined(loss_roles: tuple[str, ...], segment_chars: int):
    """Turns come in order; each segment is named by its first turn's key."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, number = None, None, 0

        def out() -> pa.RecordBatch:
            conv_id, turn, role, tie = key
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), span, pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64()), ("source", pa.string())]))]
            values = [conv_id, turn, role, tie, number, "".join(own["pieces"]), own["loss"], own["attachments"]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "turn", "role", "tie", "segment", "formatted", "loss", "attachments"])

        for batch in rows:
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "tie", "body", "attachments")), strict=True):
                *name, body, attachments = row
                if own is not None and (name[0] != key[0] or own["length"] + len(body) > segment_chars):
                    yield out()
                    number, own = number + 1, None
                if own is None:
                    own, key = {"pieces": [], "loss": [], "attachments": [], "length": 0}, name
                before, after = around(name[2])
                start = own["length"] + len(before)
                own["pieces"] += [before, body, after]
                if name[2] in loss_roles:
                    own["loss"].append({"start": start, "stop": start + len(body)})
                own["attachments"] += [a | {"at": a["at"] + start} for a in attachments]
                own["length"] = start + len(body) + len(after)
        if own is not None:
            yield out()

    return run


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), expansion: Expansion = Expansion(), segment_chars: int = SEGMENT) -> DataFrame:
    """Segments of formatted conversations: conv_id, the key of the first turn (turn, role, tie, segment), formatted, loss (spans of code points), attachments (places in the segment)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    dealt = flattened(rows, expansion).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_joined(loss_roles, segment_chars), FORMATTED)


def restored(piece: str, at: int, attachments: list[dict]) -> str:
    """What stood at formatted[at : at + len(piece)] before formatting."""
    out, upto = [], 0
    for a in attachments:
        k = a["at"] - at
        if 0 <= k < len(piece):
            out += [unescape(piece[upto:k]), a["source"]]
            upto = k + len(PLACEHOLDERS[a["kind"]])
    return "".join([*out, unescape(piece[upto:])])


def turns_of(formatted: str, attachments: list[dict]) -> list[tuple[str, str]]:
    """(role, text) of every turn that a segment holds; the k-th placeholder is the k-th attachment."""
    out, at, waiting = [], 0, 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        k = m.lastindex
        role = {1: "user", 2: "system", 5: "assistant"}.get(k) or unescape(m[3])
        own = waiting
        while own < len(attachments) and attachments[own]["at"] < m.end():
            own += 1
        out.append((role, restored(m[k], m.start(k), attachments[waiting:own])))
        at, waiting = m.end(), own
    return out


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        names = ["n_turns", "turns", "loss_chars", "loss_text", "formatted_chars", "n_attachments", "attachment_tokens"]
        values: dict[str, list] = {n: [] for n in names}
        for formatted, loss, attachments in zip(*(batch[c].to_pylist() for c in ("formatted", "loss", "attachments")), strict=True):
            turns = turns_of(formatted, attachments)
            under = "".join(restored(formatted[s["start"] : s["stop"]], s["start"], attachments) for s in loss)
            row = (len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), len(under), under, len(formatted), len(attachments), sum(a["tokens"] for a in attachments))
            for n, v in zip(names, row, strict=True):
                values[n].append(v)
        keys = ["conv_id", "turn", "role", "tie", "segment"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), *(pa.array(values[n], pa.string() if n in ("turns", "loss_text") else pa.int64()) for n in names)], names=[*keys, *names])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per segment: its key, n_turns, turns (role, newline, text, newline), loss_chars, loss_text, formatted_chars, n_attachments, attachment_tokens."""
    columns = "n_turns long, turns string, loss_chars long, loss_text string, formatted_chars long, n_attachments long, attachment_tokens long"
    return formatted.mapInArrow(_read, f"conv_id long, turn long, role string, tie string, segment int, {columns}")


_SUMS = ("n_turns", "loss_chars", "formatted_chars", "n_attachments", "attachment_tokens")
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come in order; a conversation's digests grow with each, so no more than one batch is held."""
    key, sums, turns, loss = (), None, None, None
    done: list[list] = []

    def out() -> pa.RecordBatch:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        own, done[:] = list(zip(*done, strict=True)), []
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if "sha" in n else pa.int64()) for n, v in zip(names, own, strict=True)], names=names)

    def close() -> None:
        done.append([key[0], sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), *sums[2:]])

    for batch in rows:
        for conv_id, t, x, *numbers in zip(*(batch[c].to_pylist() for c in ("conv_id", "turns", "loss_text", *_SUMS)), strict=True):
            if key != (conv_id,):
                if key:
                    close()
                key, sums, turns, loss = (conv_id,), [0] * len(_SUMS), hashlib.sha256(), hashlib.sha256()
            turns.update(t.encode())
            loss.update(x.encode())
            sums = [a + b for a, b in zip(sums, numbers, strict=True)]
        if len(done) >= 1000:
            yield out()
    if key:
        close()
    if done:
        yield out()


def digests(read: DataFrame) -> DataFrame:
    """Per conversation of read_back's segments: DIGESTS."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("segment")]
    return read.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digests, DIGESTS)


def op12(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(own)
    return digests(read_back(saved(format_conversations(rows), "formatted"))).drop("attachment_tokens")
