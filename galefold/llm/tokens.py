"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of
the pieces, put together, are the ids of the whole text (tests compare the two).
"""

from __future__ import annotations

import os
import unicodedata
from array import array

#: Pieces in a generation of the cache. A Python worker keeps two: the older one goes when the newer is full.
CACHE_PIECES = 150_000
#: Marks that may close a piece and form a token run of their own after a letter.
_MARKS = ".,;:!?#$%&*|"


class Encoder:
    """Works for byte-level BPE, which keeps white space, and for word-end BPE, which drops it."""

    _loaded: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ids = self.tokenizer.encode("a b", add_special_tokens=False).tokens
        self.keeps_space = any(t.startswith("Ġ") for t in ids)
        self.pieces, self.marks, self.odd = _Pieces(self, {}), {}, False
        self.line_end = self._encode(["\n"])[0]
        # Byte-level BPE spells bytes as characters: printable ones as themselves, the rest from U+0100 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.blank = chr(0x100 + 0x20) if self.keeps_space else ""
        self.spell = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    # A piece is a word. If white space is kept, a blank stands before it, unless it begins with a line end
    # instead; a text's first word is looked up behind a line end, whose own id is then cut off.

    def _cut(self, text: str) -> list[str]:
        if self.keeps_space:
            return ("\n" + text.replace("\n", " \n")).split(" ")
        # Any run of white space counts as a blank and none is kept. Only A-Z are made small here, as the
        # tokenizer does itself, so that fewer pieces differ.
        return text.encode().lower().decode().replace("\n", " ").split(" ")

    def _odd(self, piece: str) -> bool:
        """Other white space than one blank or line end stands at the piece, so that the text can't be cut there."""
        word = piece[1:] if piece[:1] == "\n" else piece
        return self.keeps_space and (not word or word[0].isspace() or word[-1].isspace())

    def _stays(self, word: str) -> bool:
        """The tokenizer's normalizer leaves the word as it is."""
        return self.keeps_space or (word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 2000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return out

    def ids(self, piece: str) -> bytes:
        """The ids of a piece that isn't in the cache. An odd piece sets `odd`, and its text must be encoded whole."""
        # Closing marks after a letter are a token run of their own in every pre-tokenizer here.
        if piece[-1:] in _MARKS and (core := piece.rstrip(_MARKS))[-1:].lower().isalpha():
            marks = piece[len(core) :]
            if len(self.marks) > 1000:
                self.marks.clear()
            if marks not in self.marks:
                self.marks[marks] = self._encode([marks])[0]
            return self.pieces[core] + self.marks[marks]
        if self._odd(piece):
            self.odd = True
            return b""
        at_line = self.keeps_space and piece[0] == "\n"
        word = piece[1:] if at_line else piece
        # One run of letters is one word to every pre-tokenizer here, and goes to the library's model directly.
        if word.isalpha() and self._stays(word):
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.spell)
            own = array("I", [t.id for t in self.tokenizer.model.tokenize(self.blank + spelt if not at_line else spelt)]).tobytes()
            return self.line_end + own if at_line else own
        return self._encode([piece if at_line or not self.keeps_space else " " + piece])[0] if piece else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        drop, out = 4 if self.keeps_space else 0, []
        for text in texts:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces = _Pieces(self, dict(self.pieces))
            self.odd = False
            ids = b"".join(map(self.pieces.__getitem__, self._cut(text)))[drop:]
            out.append(self._encode([text])[0] if self.odd else ids)
        return out


class _Pieces(dict):
    """The newer generation of the cache; what it lacks comes from the older one or is encoded."""

    def __init__(self, encoder: Encoder, older: dict[str, bytes]):
        self.encoder, self.older = encoder, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = b"" if self.encoder.odd else self.encoder.ids(piece)
            if self.encoder.odd:
                return ids
        self[piece] = ids
        return ids
