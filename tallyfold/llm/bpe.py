"""Encoding with a `tokenizers` file, with a memo of white-space-delimited units.

The pre-tokenizers of the files in use never join anything across a boundary between two units, so
a text's ids are its units' ids one after the other.  Units are encoded by the library itself, each
new one once per worker: plain words by its model alone, which is what its normalizer and
pre-tokenizer make of them, and everything else by the whole tokenizer.

Files that drop white space have a shorter way for a column of texts: Arrow splits it and numbers
the different words, so that Python sees each of them once per step, and ids are gathered by number.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the library's pattern classes define it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
#: Letters of one alphabet, and the marks that never belong to the same pre-token as a letter before them.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,!?;:#*$%&|()\[\]{}<>/\"+="
_WORD = f"[{_LETTERS}]+(?=[{_MARKS}{_WS}]|$)"
#: Byte-level files: a space belongs to the word after it; a longer run leaves only its last character.
_SPACED = re.compile(f" ?{_WORD}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: Files that drop white space.
_BARE = re.compile(f"{_WORD}|[^{_WS}]+")

_PLAIN = re.compile(f" ?[{_LETTERS}]+").fullmatch

#: Words that the memo may hold (and half as many units).  The memo of units is emptied as a whole.
MEMO_UNITS = 1_000_000
MEMO_UNIT_CHARS = 64


def _byte_letters() -> dict[int, str]:
    """Byte -> the character that byte-level models have for it: itself where it can be seen, and the
    characters from U+0100 on for all others, in the order of bytes."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


class _Memo(dict):
    """Unit -> ids as bytes; units that aren't there are encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= MEMO_UNIT_CHARS:  # longer units are used, but not kept
            self[unit] = ids
        return ids


class _Numbered(dict):
    """Word -> its number; ``at`` and ``size`` tell where in ``flat`` the ids of each number are."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.at, self.size = np.empty(0, "<u4"), np.empty(0, "i8"), np.empty(0, "i8")
        self.used = np.empty(0, "i4")
        self.new: list[bytes] = []

    def trim(self) -> None:
        """Keeps the words that more than one step had, up to half of what the memo may hold."""
        kept = np.flatnonzero(self.used > 1)
        kept = kept[np.argsort(-self.used[kept], kind="stable")[: MEMO_UNITS // 2]]
        words = np.array(list(self), object)[kept].tolist()
        size = self.size[kept]
        at = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.at[kept] - at, size) + np.arange(size.sum())]
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self.flat, self.at, self.size, self.used = flat, at, size, np.ones(len(words), "i4")

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(self.encode(word))
        return number

    def numbers(self, words: np.ndarray) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), "i8", len(words))
        if self.new:
            size = np.array([len(r) // 4 for r in self.new], "i8")
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(self.new), "<u4")])
            self.used = np.concatenate([self.used, np.zeros(len(size), "i4")])
            self.new = []
        self.used[found] += 1
        return found


_open: dict[str, Encoder] = {}


class Encoder:
    """``ids(texts)``: per text its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bare = spec["normalizer"] is not None
        self.units = (_BARE if self.bare else _SPACED).findall
        self.vocab = self.tok.get_vocab_size()
        self.pieces = self.tok.model.tokenize
        self.memo = _Memo(self._unit)
        self.words = _Numbered(self._word)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, unit: str) -> bytes:
        if not _PLAIN(unit):
            return self._whole([unit])[0]
        letters = unit.lower() if self.bare else unit
        if not self.bare or not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.pieces(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        return self._unit(word) if _PLAIN(word) else b"".join(map(self.memo.__getitem__, self.units(word)))

    def _tidy(self) -> None:
        if len(self.memo) > MEMO_UNITS // 2:
            self.memo.clear()
        if len(self.words) > MEMO_UNITS:
            self.words.trim()

    def forget(self) -> None:
        self.memo.clear()
        self.words.clear()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column without nulls, one after the other, and how many each text has."""
        if not self.bare or any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            raws = self.ids(texts.to_pylist())
            return np.frombuffer(b"".join(raws), "<u4"), np.array([len(r) // 4 for r in raws], "i8")
        self._tidy()
        split = pc.ascii_split_whitespace(texts)
        of_text = split.offsets.to_numpy().astype("i8")
        coded = split.flatten().dictionary_encode()
        number = self.words.numbers(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        n = self.words.size[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.words.flat[np.repeat(self.words.at[number] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[of_text - of_text[0]])

    def ids(self, texts: list[str]) -> list[bytes]:
        self._tidy()
        look, units = self.memo.__getitem__, self.units
        # special strings are cut out before units are formed
        return [self._whole([t])[0] if any(s in t for s in self.special) else b"".join(map(look, units(t))) for t in texts]


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def forget() -> None:
    """Empties the memos of this worker, for kernels that need the memory and don't encode."""
    for enc in _open.values():
        enc.forget()
