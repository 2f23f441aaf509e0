"""Token ids of whole texts with a public tokenizer file, segment by segment.

A byte-pair tokenizer never merges across the places where its own splitting pattern cuts, and a change from a
non-blank to a blank character is such a place for every tokenizer file used here. So a text's ids are the ids of its
segments (a run of blanks and the run of non-blanks behind it) one after the other. Where the tokenizer drops blanks,
the runs of non-blanks alone are the segments.

A worker keeps the ids of segments that it has seen, up to ``CACHE_SEGMENTS`` of them. A new segment that is a plain
word, with or without marks behind it, goes straight to the library's byte-pair model, which is what the library does
with it after normalizing and splitting; all other segments go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers
from tokenizers import Tokenizer

CACHE_SEGMENTS = 500_000
#: Longer segments are encoded but not kept.
KEPT_LENGTH = 64
#: Characters that Python takes for blanks and the tokenizers' patterns do not.
UNSURE = re.compile("[\x1c-\x1f]")
SEGMENT = re.compile(r"\s*\S+|\s+")
#: A word of letters that every normalization leaves alone but for lower case, and marks that begin no special string and no contraction.
PLAIN = re.compile(r'([\n ]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?()\[\]{}"#$%&*+/=@\\^~-]*)')


def byte_chars() -> list[str]:
    """The character by which byte-level tokenizers write each byte: itself if it is printed, else one beyond 255."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return [chr(b) if b in printed else chr(256 + others.index(b)) for b in range(256)]


class _Uneven(Exception):
    """A text whose blanks are not single."""


class _Spaced(dict):
    """Ids of segments by what stands behind their blank."""

    def __init__(self, encoder: SegmentEncoder):
        self.encoder = encoder

    def __missing__(self, rest: str) -> bytes:
        if not rest or len(parts := rest.split()) != 1 or parts[0] != rest:
            raise _Uneven
        return self.encoder.keep(self, rest, self.encoder.segment(" " + rest))


class _Known(dict):
    """Ids of segments."""

    def __init__(self, encoder: SegmentEncoder):
        self.encoder = encoder

    def __missing__(self, segment: str) -> bytes:
        return self.encoder.keep(self, segment, self.encoder.segment(segment))


class SegmentEncoder:
    """Ids (little-endian unsigned 32-bit numbers) of whole texts."""

    def __init__(self, file: str):
        self.file = file
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.known, self.spaced = _Known(self), _Spaced(self)
        self.model, self.chars = self.tokenizer.model, byte_chars()
        parts = json.loads(self.tokenizer.to_str())
        level, cut = parts["pre_tokenizer"] or {}, (parts["normalizer"] or {}).get("normalizers", [])
        #: Byte-level splitting of its own, which keeps blanks.
        self.keeps_blanks = parts["normalizer"] is None and level.get("type") == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"]
        #: Lower case, blanks of no effect, letters split from all else, then bytes.
        steps = level.get("pretokenizers", [])
        self.drops_blanks = [x["type"] for x in cut] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and r"[\p{L}]+" in steps[0]["pattern"]["Regex"] and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"]["Regex"]

    def keep(self, table: dict, key: str, ids: bytes) -> bytes:
        if len(key) <= KEPT_LENGTH:
            if len(self.known) + len(self.spaced) >= CACHE_SEGMENTS:
                self.known.clear()
                self.spaced.clear()
            table[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if not word.isascii() or word[0] == " ":
            word = "".join(map(self.chars.__getitem__, word.encode()))
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()

    def segment(self, segment: str) -> bytes:
        """The ids of a segment that is not known."""
        plain = PLAIN.fullmatch(segment) if self.keeps_blanks or self.drops_blanks else None
        if plain is None:
            return array("I", self.tokenizer.encode(segment, add_special_tokens=False).ids).tobytes()
        blank, word, marks = plain.groups()
        if self.drops_blanks:
            ids = self._word(word.lower())
        elif blank == "\n":
            ids = self.known[blank] + self._word(word)
        else:
            ids = self._word(blank + word)
        return ids + self.known[marks] if marks else ids

    def encode_text(self, text: str) -> bytes:
        if UNSURE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.drops_blanks:
            return b"".join(map(self.known.__getitem__, text.split()))
        if self.keeps_blanks:
            out = []
            for number, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                try:
                    if not first or len(first.split()) != 1:
                        raise _Uneven
                    out.append(self.known["\n" + first if number else first])
                    out += map(self.spaced.__getitem__, rest)
                except _Uneven:
                    break
            else:
                return b"".join(out)
        return b"".join(map(self.known.__getitem__, SEGMENT.findall(text)))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; none for null."""
        return (self.encode_text(text) if text else b"" for text in texts)


_encoders: dict[str, SegmentEncoder] = {}


def encoder(file: str) -> SegmentEncoder:
    """One encoder for each worker process and file."""
    if file not in _encoders:
        _encoders[file] = SegmentEncoder(file)
    return _encoders[file]
