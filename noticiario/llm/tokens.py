"""Token ids of whole texts, as bytes of little-endian unsigned 32-bit integers."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa

# A worker keeps the words of two generations of this many (about 60 MB each).
KNOWN_WORDS = 300_000
# Texts are cut into pieces so many bytes at a time.
BATCH_BYTES = 1 << 22

# Texts whose letters change case one by one and have no combining marks.
_ODD = re.compile("[^\x00-\u024f]|\u0130|<\\|")
_BLANK = np.isin(np.arange(256), (0x20, 0x0A))
_ASCII_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_LOWER = np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint8)
# The letters of two bytes in such texts, by lead byte and following byte.
_LATIN_LETTER = np.zeros(1 << 16, bool)
_LATIN_LETTER[[
    int.from_bytes(chr(c).encode(), "big")
    for c in range(0x80, 0x250) if unicodedata.category(chr(c)).startswith("L")
]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter, in texts that ``_ODD`` does not match."""
    found = _ASCII_LETTER[data]
    lead = np.flatnonzero(data >= 0x80)[::2]
    if len(lead):
        found[lead] = found[lead + 1] = _LATIN_LETTER[data[lead].astype(np.int32) << 8 | data[lead + 1]]
    return found


def _pieces(texts: list[bytes], plain: bool) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of all texts in order, and the number of pieces before each text and in all."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    blank = _BLANK[data]
    after = np.concatenate(([True], blank[:-1]))[: len(data)]
    if plain:
        letter = _letters(data)
        after[1:] |= letter[:-1] & ~letter[1:]
        data = _LOWER[data]
    kept = ~blank
    first = after & kept
    data, begins = data[kept], np.flatnonzero(first[kept])
    places = pa.py_buffer(np.append(begins, len(data)))
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, places, pa.py_buffer(data)]
    )
    ends = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return found, np.searchsorted(np.flatnonzero(first), ends)


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, piece by piece.

    Exact for tokenizers that lower-case, drop white space, and never join letters with what
    follows them (``splits_at_blanks`` tells; others get whole texts): the ids of a text are
    those of its pieces in order. Pieces recur: those of many texts are cut and counted off
    together, each different one is looked up once, and only new ones go to the library. A
    plain text is cut at blanks, line feeds and after letters; one with special tokens, combining
    marks or letters beyond Latin is cut at blanks and line feeds alone.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_piece = self.splits_at_blanks()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def splits_at_blanks(self) -> bool:
        """Whether blank-separated pieces can be encoded alone, judged by its parts."""
        spec = json.loads(self.tokenizer.to_str())
        splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = next((s for s in splitters if s["type"] == "Split"), None)
        normalizers = json.dumps(spec.get("normalizer"))
        drops = (
            '"Lowercase"' in normalizers and "\\\\s+" in normalizers
            and split is not None and split["behavior"] == "Removed" and split["invert"]
            and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
            and not any(s.get("add_prefix_space") for s in splitters)
        )
        return drops and not any(
            t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or " " in t["content"]
            for t in spec.get("added_tokens", [])
        )

    def _library(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Make all of some different pieces known."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [p for p in pieces if p not in known]
        if older:
            known.update((p, older[p]) for p in new if p in older)
            new = [p for p in new if p not in older]
        known.update(zip(new, self._library([p.decode() for p in new]), strict=True))

    def _looked_up(self, texts: list[bytes], plain: bool) -> Iterator[bytes]:
        pieces, bounds = _pieces(texts, plain)
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(different)
        ids = pa.array([self.known[p] for p in different], pa.large_binary()).take(coded.indices)
        places, held = ids.buffers()[1:]
        held = memoryview(held) if held else memoryview(b"")
        places = np.frombuffer(places, np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
        for begin, end in pairwise(places):
            yield bytes(held[begin:end])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_piece:
            return list(self._library(texts))
        out = [b""] * len(texts)
        waiting: dict[bool, list[tuple[int, bytes]]] = {True: [], False: []}
        size = {True: 0, False: 0}
        for i, text in enumerate(texts):
            plain = (text.isascii() and "<|" not in text) or not _ODD.search(text)
            waiting[plain].append((i, text.encode()))
            size[plain] += len(waiting[plain][-1][1])
            if size[plain] >= BATCH_BYTES:
                self._take(waiting[plain], plain, out)
                waiting[plain], size[plain] = [], 0
        for plain, held in waiting.items():
            self._take(held, plain, out)
        return out

    def _take(self, held: list[tuple[int, bytes]], plain: bool, out: list[bytes]) -> None:
        if held:
            for (i, _), ids in zip(held, self._looked_up([t for _, t in held], plain), strict=True):
                out[i] = ids


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder for each tokenizer and worker process."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def specification(path: str) -> str:
    """Content of a tokenizer file, to be sent to the tasks (a few MB, fixed size)."""
    return Path(path).read_text(encoding="utf-8")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
