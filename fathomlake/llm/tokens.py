"""Ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence
from functools import lru_cache

#: White space other than space and newline, as any library may define it.
_ODD_SPACE = [c for c in map(chr, range(1, 0x3001)) if (c.isspace() or c == "᠎") and c not in " \n"]
#: Words of Latin-1 letters, with newlines before them at most.
_PLAIN = re.compile(r"(\n{0,2})([A-Za-zÀ-ÖØ-öø-ÿ]+)").fullmatch
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: How byte-level tokenizers spell bytes: printable ones as themselves, the rest from U+0100 on.
_SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Words whose ids are remembered, by default.
ROOM = 500_000


class _Words(dict):
    """Ids of parts of texts; at most twice ``room`` of them, the latest used."""

    def __init__(self, encode, room: int):
        self._encode, self._room, self._older = encode, room, {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self._room:
            self._older = dict(self)
            self.clear()
        found = self._older.get(part)
        if found is None:
            # a word before a full stop or comma is mostly known without it
            found = self[part[:-1]] + self.marks[part[-1]] if part[-1] in self.marks and part[-2:-1].isalpha() else self._encode(part)
        self[part] = found
        return found


class Encoder:
    """Encodes texts by the tokenizers library, remembering the ids of words.

    With ``by_words`` a text is cut before every single space or newline that stands between other
    characters, and each part is encoded once for many texts. This gives the ids of the whole text
    for tokenizers whose pre-tokenizer begins a new piece there, as byte-level and word-end BPE
    do. Texts with any other white space are encoded whole. Strings of special tokens are ordinary
    text. ``room`` bounds the memory; more distinct words than that only cost time.
    """

    def __init__(self, path: str, by_words: bool = True, room: int = ROOM):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._by_words = by_words
        self._words = _Words(self._encode_part, room)
        self._lead: str | None = None
        self._lower = False
        self._learn_spelling()

    def _learn_spelling(self) -> None:
        """See how words reach the library's model, and send plain ones there directly if that gives the same ids."""
        tokenizer = self._tokenizer
        normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        pieces = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal(" AB"))] if tokenizer.pre_tokenizer else []
        if len(pieces) != 1 or not pieces[0].lower().endswith("ab"):
            return
        self._lead, self._lower = pieces[0][:-2], pieces[0].endswith("ab")
        self._newline = self._encode_whole("\n")
        self._words.marks = {mark: self._encode_whole(mark) for mark in ".,"}
        words = ("ab", "Wörter", "ÀÉß,", "The.", "ÿ", "x,", "hundreds")
        if any(self._words[lead + w] != self._encode_whole((lead or " ").replace("\n\n", "") + w) for w in words for lead in ("", "\n", "\n\n")):
            self._lead = None
            self._words.marks = {}
        self._words.clear()

    @property
    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode_whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_part(self, part: str) -> bytes:
        """A part stands for itself after a space, or after the newline that it begins with; two
        newlines mark the first part of a text, which stands for itself alone."""
        if self._lead is not None:
            start, word = "", part
            if not (part.isascii() and part.isalpha()):
                plain = _PLAIN(part)
                start, word = plain.groups() if plain else ("", "")
            if word:
                if self._lower:
                    word = word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_SPELT)
                ids = [t.id for t in self._tokenizer.model.tokenize(word if start else self._lead + word)]
                return (self._newline if start == "\n" else b"") + (_PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids))
        return self._encode_whole(part[2:] if part[:2] == "\n\n" else part if part[:1] == "\n" else " " + part)

    def encode(self, texts: Sequence[str], end: int | None = None) -> list[bytes]:
        """The ids of each text, with ``end`` after them unless it is None."""
        tail = b"" if end is None else struct.pack("<I", end)
        found, ids_of = [], self._words.__getitem__
        for text in texts:
            parts = ("\n\n" + text.replace("\n", " \n")).split(" ") if self._by_words else None
            # runs of white space and white space at the ends leave such parts
            if parts is None or "" in parts or "\n" in parts or parts[0] == "\n\n" or any(c in text for c in _ODD_SPACE):
                found.append(self._encode_whole(text) + tail)
            else:
                found.append(b"".join(map(ids_of, parts)) + tail)
        return found


@lru_cache(maxsize=4)
def encoder(path: str, room: int = ROOM) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, room=room)
