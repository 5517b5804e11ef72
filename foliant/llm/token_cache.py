"""Segment caches that make the tokenizers library's results cheap on natural text.

A text is cut at places where the tokenizer itself always cuts, each distinct segment is encoded once by the library,
and the ids are joined from the cache. The cache is bounded; when full it starts anew, which changes no result.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from foliant.llm.common import held

MAX_SEGMENTS = 500_000
SLICE_CHARS = 1 << 20  # of texts whose segments are in memory at once; a longer text is a slice of its own
#: ASCII and Latin-1 letters as UTF-8, with the space that byte-level rules put before a word.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The same, then punctuation without the apostrophe, after which contractions may follow.
_WORD_MARKS = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")
_UPPER = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
#: White space outside ASCII, and the separators that Python's or Unicode's rules see differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is kept, the rest follows 255."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(shifted)) for b in range(256)]


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


class _Cached:
    def __init__(self, path: str):
        self.tok = _load(path)
        self.model = self.tok.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[bytes, bytes] = {}
        wide = self.tok.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4") if wide else np.dtype("<u2")
        self.code = "I" if wide else "H"

    def pack(self, ids: list[int]) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def one(self, piece: bytes) -> bytes:
        """Ids of bytes that the tokenizer's splitting leaves in one piece."""
        return self.pack([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.symbols))])

    def learn(self, segments: set[bytes]) -> None:
        new = segments.difference(self.known)
        if len(self.known) + len(new) > MAX_SEGMENTS:
            self.known.clear()
            new = segments
        for s in new:
            self.known[s] = self.encode_segment(s)

    def _parts(self, s: bytes) -> bytes | None:
        """A word of letters with punctuation after it: two pieces, each known or encoded for itself."""
        m = _WORD_MARKS.fullmatch(s)
        if not m:
            return None
        ids = b""
        for part in m.groups():
            if part not in self.known:
                self.known[part] = self.one(part)
            ids += self.known[part]
        return ids

    def encode_segment(self, s: bytes) -> bytes:
        if _LETTERS.fullmatch(s):
            return self.one(s)
        return self._parts(s) or self.whole(s.decode("utf-8"))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; segments are made for a slice of the texts at a time."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size < SLICE_CHARS or upto == at):
                size += len(texts[upto])
                upto += 1
            cut = [self.segments(t) for t in texts[at:upto]]
            self.learn(set().union(*[c for c in cut if c]))
            get = self.known.__getitem__
            out.extend(self.whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts[at:upto], cut))
            at = upto
        return out


class ByteLevel(_Cached):
    """For vocabularies with the byte-level splitting rule, which puts one space before a word into its piece."""

    _segments = re.compile(rb" ?[^\s]+|\s+(?!\S)|\s")

    def segments(self, text: str) -> list[bytes] | None:
        return None if _ODD_SPACE.search(text) else self._segments.findall(text.encode("utf-8"))


def _lower(text: str) -> bytes:
    """UTF-8 with ASCII and Latin-1 letters lower-cased; the library's own lower-casing follows."""
    data = text.encode("utf-8")
    return data.lower() if text.isascii() else _UPPER.sub(lambda m: b"\xc3" + bytes([m[0][1] + 32]), data.lower())


class SpaceFree(_Cached):
    """For vocabularies that lower-case, drop white space and end words with a mark."""

    def segments(self, text: str) -> list[bytes]:
        return _lower(text).split()


def cached(kind: type, path: str):
    """One cache for each worker process."""
    return held((kind, path), lambda: kind(path))
