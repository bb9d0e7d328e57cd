"""Token ids of whole texts with a public tokenizer file, with a bounded cache of the ids of single pieces.

A text is cut before white space that follows other characters (or at white space, for tokenizers that drop it). The pieces of a slice of texts are
named by their hashes, lengths and first bytes and looked up in a table of numpy arrays, and the ids of all are gathered. A new piece of plain Latin
letters, digits and marks is split as the tokenizer's splitter does and each word goes to the tokenizer's model; any other piece goes to the whole
tokenizer. The cut changes no ids for tokenizers that split words at white space: ``LEADING`` for those that count one leading
space to a word, ``BARE`` for those that drop white space. Texts with control characters, or white space other than space, tab and
line ends, are encoded whole.
"""

from __future__ import annotations

import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words, flat, gather, table


class Style(NamedTuple):
    """How a tokenizer splits: the ``words`` of a piece of plain letters, digits and marks, and ``one``, a piece of a word and perhaps a mark.

    ``spaced``: a leading space belongs to its word; else white space is dropped and letters are lowered.
    """

    words: str
    one: str
    spaced: bool


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SHORT = "'(?:s|t|re|ve|m|ll|d)"
LEADING = Style(rf"{SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+", rf"( ?[{LETTERS}]+)([!-&(-/:;=?@]*)", True)
BARE = Style(rf"{SHORT}|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+", rf"([{LETTERS}]+)([!-&(-/:;=?@]*)", False)
_BLANKS = table({0x20, 0x09, 0x0A, 0x0D}, lower=False)
_PLAIN = re.compile(rf"[ \t\r\n!-;=-~{LETTERS}]+")  # without <, which opens the tokenizers' special strings
CACHE_WORDS, CACHE_PIECES = 500_000, 1_500_000
ODD_RANGES = (  # control and format characters, and white space beyond space, tab and line ends
    (0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0xA0), (0xAD, 0xAD), (0x1680, 0x1680), (0x180E, 0x180E),
    (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
_ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD_RANGES) + "]")
_ENCODERS: dict[tuple[str, Style], "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself, or the next free one above 255."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known:
    """Ids of pieces in flat arrays, found by 64-bit hashes in an open table with linear probing."""

    def __init__(self) -> None:
        self.count = 0
        self.hash, self.head = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.size, self.place, self.ids = np.zeros(1, np.int64), np.zeros(2, np.int64), np.zeros(1, "<u4")
        self._open(1 << 16)

    def _open(self, slots: int) -> None:
        self.bits = slots.bit_length() - 1
        self.keys, self.refs = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self._put(np.arange(self.count))

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for unknown ones."""
        found, slot, left = np.full(len(hashes), -1, np.int64), self._slot(hashes), np.arange(len(hashes))
        while len(left):
            held = self.keys[slot[left]]
            hit = held == hashes[left]
            found[left[hit]] = self.refs[slot[left[hit]]]
            left = left[~hit & (held != 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return found

    def _put(self, refs: np.ndarray) -> None:
        slot = self._slot(self.hash[refs])
        while len(refs):
            free = self.keys[slot] == 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = np.zeros(len(refs), bool)
            placed[first] = free[first]
            self.keys[slot[placed]], self.refs[slot[placed]] = self.hash[refs[placed]], refs[placed]
            refs, slot = refs[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def add(self, hashes: np.ndarray, size: np.ndarray, head: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Numbers of new pieces with different hashes."""
        n, refs = self.count + len(hashes), np.arange(self.count, self.count + len(hashes))
        ends = self.place[self.count] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        for name, values, at in (("hash", hashes, refs[0]), ("head", head, refs[0]), ("size", size, refs[0]), ("place", ends, refs[0] + 1),
                                 ("ids", np.frombuffer(b"".join(ids), "<u4"), self.place[self.count])):
            held, stop = getattr(self, name), at + len(values)
            if stop > len(held):
                held = np.append(held, np.zeros(max(stop, 2 * len(held)) - len(held), held.dtype))
                setattr(self, name, held)
            held[at:stop] = values
        self.count = n
        if 2 * n > len(self.keys):
            self._open(1 << (2 * n).bit_length())
        else:
            self._put(refs)
        return refs


class Encoder:
    """Ids of texts; the caches of words and pieces are emptied when they hold more than CACHE_WORDS and, between slices, CACHE_PIECES."""

    def __init__(self, path: str, style: Style):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = style.spaced
        self.one, self.split = re.compile(style.one).fullmatch, re.compile(style.words).findall
        self.letters = byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = Known()
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """By the whole tokenizer."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([self.id_bytes[i] for i in ids])

    def _word(self, word: str) -> bytes:
        """By the tokenizer's model alone: the word is one unit of its splitter."""
        ids = self.words.get(word)
        if ids is None:
            plain = word.isascii() and word.isalpha()
            name = word if plain else word.encode().decode("latin-1").translate(self.letters)
            ids = self.words[word] = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(name)])
        return ids

    def _piece(self, raw: bytes) -> bytes:
        piece = raw.decode()
        read = piece if self.spaced else piece.lower()
        simple = self.one(read)
        if simple:
            word, marks = simple.groups()
            return self._word(word) + self._word(marks) if marks else self._word(word)
        return b"".join(map(self._word, self.split(read))) if _PLAIN.fullmatch(piece) else self.whole(piece)

    def _pieces(self, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """(words, start and end of each piece, number of pieces before each text)."""
        words = Words(*flat(column), _BLANKS)
        if not self.spaced:
            return words, words.start, words.end, words.first
        last = np.append(-1, words.end)[words.first[1:]]  # end of the last word before the end of each text
        after = np.maximum(last, words.offsets[:-1])
        tails = np.flatnonzero(after < words.offsets[1:])  # white space behind the last word, or alone
        ends = np.insert(words.end, words.first[1:][tails], words.offsets[1:][tails])
        first = words.first + np.searchsorted(tails, np.arange(len(words.first)))
        return words, np.append(0, ends[:-1])[: len(ends)], ends, first

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end`` if given, and how many each text has; null has no ids of its own."""
        strange = np.array([bool(t) and _ODD.search(t) is not None for t in texts.to_pylist()], bool)
        plain = pc.if_else(pa.array(strange), "", texts) if strange.any() else texts
        words, start, stop, first = self._pieces(plain)
        raw, size = words.data.tobytes(), stop - start
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        if self.known.count > CACHE_PIECES:
            self.known = Known()
        known, hashes, head = self.known, np.maximum(words.hashes(start, stop), np.uint64(1)), first_bytes(words.data, start, size)
        number = known.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            different, at, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[at]
            found = [self._piece(raw[a:b]) for a, b in zip(start[at].tolist(), stop[at].tolist())]
            number[new] = known.add(different, size[at], head[at], found)[which]
        same = (size == known.size[number]) & (head == known.head[number])
        if same.all():
            ids, before = gather(known.ids, known.place[number], known.place[number + 1])
        else:  # two pieces of one hash
            found = [self._piece(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
            ids, before = np.frombuffer(b"".join(found), "<u4"), np.append(0, np.cumsum([len(x) // 4 for x in found], dtype=np.int64))
        sizes = np.diff(before[first])
        if strange.any():
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(strange):
                parts[i] = np.frombuffer(self.whole(texts[int(i)].as_py()), "<u4")
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if end is not None:
            sizes = sizes + 1
            out, last = np.full(len(ids) + len(sizes), end, "<u4"), np.cumsum(sizes) - 1
            inside = np.ones(len(out), bool)
            inside[last] = False
            out[inside] = ids
            ids = out
        return ids, sizes

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes."""
        ids, sizes = self.column(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def first_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as one number, 0 where it is shorter."""
    padded = np.append(data, np.zeros(8, np.uint8))
    out = np.zeros(len(start), np.uint64)
    for j in range(8):
        out |= np.where(size > j, padded[start + j], 0).astype(np.uint64) << np.uint64(8 * j)
    return out


def encoder(path: str, style: Style) -> Encoder:
    """One encoder for each worker process."""
    if (path, style) not in _ENCODERS:
        _ENCODERS[path, style] = Encoder(path, style)
    return _ENCODERS[path, style]
