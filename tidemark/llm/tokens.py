"""Token ids of whole texts with the tokenizers library, through bounded caches of pieces.

The two known pre-tokenisations never join what stands on two sides of certain white space,
so a text is split there and each distinct piece is encoded once per worker. A new piece
of plain characters is split into its runs of letters, digits and other signs, as the
pre-tokenisation does, and each distinct run goes to the tokenizer's model once. Pieces
with other characters are encoded by the whole tokenizer, and so are texts in which the
split isn't provably neutral, texts that hold the string of an added token (which is that token, as in
the library's plain call) and all texts of other kinds of tokenizers.

``batch`` does the same for a column of texts: numpy cuts all texts into pieces, and plain pieces into their runs, Arrow tells
them apart, each different one is looked up once a batch, and the ids are put together from their numbers. New plain runs go to
the model many at a time, behind a sign between them that no merge of the vocabulary holds, so that none is merged across it.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import CHUNK, column, range_hash, rolled, words
from .workspace import lean

_UNEVEN = re.compile(r" \s|\s ")
_ODD_SPACE = re.compile(r"[^\S \n\t\r]")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Pieces that a cache holds, by kind of tokenizer.
ENTRIES = {"bytes": 600_000, "words": 200_000}
#: Bytes of text an entry that the pieces of batches may hold on the average.
BYTES_EACH = 64
LOADED: dict[tuple[str, int], PieceEncoder] = {}

# Letters of Latin-1 that normalisation leaves as they are, digits, and ASCII signs but the apostrophe.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: By kind of tokenizer: whole plain pieces (a single line feed is a run of its own), and their runs.
_PLAIN = {"bytes": re.compile(rf"(?:[{_LETTERS}0-9{_SIGNS}]|\n(?!\n))+"), "words": re.compile(rf"[{_LETTERS}0-9{_SIGNS}]+")}
_RUNS = {"bytes": re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+|\n"), "words": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")}


#: By kind of tokenizer: the bytes that separate pieces.
_SEPARATORS = {"bytes": [0x20], "words": [0x20, 0x09, 0x0A, 0x0D]}
#: White space beside those of one byte, as UTF-8 (fixed values): its second and third bytes by its first.
_WIDE_SPACES = {0xC2: [(0x85,), (0xA0,)], 0xE1: [(0x9A, 0x80)], 0xE2: [*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)], 0xE3: [(0x80, 0x80)]}


#: Of bytes: letter, digit, sign, line feed or space, 0 for those that are not plain.
_LETTER, _DIGIT, _SIGN, _FEED, _BLANK = 1, 2, 3, 4, 5
_CLASS = np.array([_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _FEED if b == 10 else _BLANK if b == 32 else _SIGN if 33 <= b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)


def _byte_signs() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_SIGN_OF_BYTE = _byte_signs()
_SPACE = chr(_SIGN_OF_BYTE[32])
_SIGNS_OF_BYTES = np.array([_SIGN_OF_BYTE.get(b, b) for b in range(256)], "<u2")
#: Bytes that no plain run holds: one stands between runs, the other between groups of so many runs that go to the model as one.
_BETWEEN, _BREAK, GROUP = "\0", "\1", 64


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8."""
    kind = _CLASS[data]
    # Two bytes of a letter of Latin-1 count as letters; other bytes from 128 on are not plain.
    lead = np.flatnonzero(data == 0xC3)
    after = np.concatenate([data, np.zeros(1, np.uint8)])[lead + 1]
    good = lead[(after != 0x97) & (after != 0xB7)]
    kind[good] = kind[good + 1] = _LETTER
    return kind


class Cache(dict):
    """Ids by piece; a missing one is encoded when it is asked for, and a full cache starts anew."""

    def __init__(self, encode: Callable[[str], bytes], entries: int) -> None:
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) >= self.entries:
            self.clear()
        self[piece] = ids
        return ids


class Lists:
    """Lists of integers one after another in an array that grows; a list is known by its number."""

    def __init__(self, kind: str) -> None:
        self.n = 0
        self.begin, self.held = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, kind)

    def put(self, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Adds lists of these sizes, whose values these are; returns their numbers."""
        first, at = self.n, int(self.begin[self.n])
        self.n += len(sizes)
        self.begin, self.held = self._room(self.begin, self.n + 1), self._room(self.held, at + len(values))
        self.begin[first + 1 : self.n + 1] = at + np.cumsum(sizes)
        self.held[at : at + len(values)] = values
        return np.arange(first, self.n)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (len + 1) and values of the lists one after another."""
        begin = self.begin[numbers]
        off = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(self.begin[numbers + 1] - begin, out=off[1:])
        at = np.repeat(begin - off[:-1], np.diff(off))
        at += np.arange(off[-1])
        return off, self.held[at]

    @staticmethod
    def _room(held: np.ndarray, size: int) -> np.ndarray:
        if size <= len(held):
            return held
        out = np.zeros(max(size, len(held) + len(held) // 2), held.dtype)
        out[: len(held)] = held
        return out


class Known:
    """Numbers of the pieces that have been met, found by a hash and compared byte for byte, and their ids."""

    def __init__(self) -> None:
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pieces, self.ids = Lists("u1"), Lists("<u4")

    def find(self, h: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each piece (offsets at), -1 if it is new."""
        out = np.full(len(h), -1)
        order = np.argsort(h)
        place = np.searchsorted(self.hash, h[order])
        met = place < len(self.hash)
        met[met] = self.hash[place[met]] == h[order[met]]
        out[order[met]] = self.number[place[met]]
        size = np.diff(at)
        out[(out >= 0) & (self.pieces.begin[out + 1] - self.pieces.begin[out] != size)] = -1
        same = out >= 0
        off, held = self.pieces.get(out[same])
        unlike = np.flatnonzero(held != data[np.repeat(same, size)])
        out[np.flatnonzero(same)[np.searchsorted(off, unlike, "right") - 1]] = -1
        return out

    def add(self, h: np.ndarray, sizes: np.ndarray, pieces: np.ndarray, id_sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new pieces; one with the hash of another will be new again."""
        self.pieces.put(sizes, pieces)
        numbers = self.ids.put(id_sizes, ids)
        h, first = np.unique(h, return_index=True)
        place = np.searchsorted(self.hash, h)
        free = np.ones(len(h), bool)
        inside = place < len(self.hash)
        free[inside] = self.hash[place[inside]] != h[inside]
        self.number = np.insert(self.number, place[free], numbers[first[free]])
        self.hash = np.insert(self.hash, place[free], h[free])
        return numbers


class PieceEncoder:
    """ids(text): little-endian unsigned 32-bit ids of encode(text, add_special_tokens=False).

    With plain_specials the strings of added tokens are ordinary text.
    """

    def __init__(self, path: str, entries: int | None = None, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = sorted(t.content for t in added)
        # An added token that is looked for in normalised text may stand behind other characters.
        self.kind = "" if any(t.normalized for t in added) else self._kind()
        entries = entries or ENTRIES.get(self.kind, 0)
        # With a byte-level split a piece carries the one space before it; otherwise white space only separates.
        self.first = Cache(lambda piece: self._new(piece, ""), entries)
        self.entries, self.known = entries, Known()
        self.bare = self._bare()
        self.rest = Cache(lambda piece: self._new(piece, " "), entries) if self.kind == "bytes" else self.first

    def _bare(self):
        """A tokenizer of the model alone, if runs can go to it joined: its merges are all that it does, and none holds the sign between runs."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        m = self.model
        if self.kind != "bytes" or not isinstance(m, BPE) or m.dropout or m.ignore_merges or m.continuing_subword_prefix or m.end_of_word_suffix:
            return None
        vocab, sign = self.tokenizer.get_vocab(with_added_tokens=False), chr(_SIGN_OF_BYTE[ord(_BETWEEN)])
        # Signs that the vocabulary lacks would be left out.
        if any(chr(c) not in vocab for c in _SIGNS_OF_BYTES.tolist()) or sum(sign in token for token in vocab) != 1:
            return None
        self.between = vocab[sign]
        return Tokenizer(m)

    def _raw(self, key: str) -> bytes:
        """The ids of a piece or run that stands as its bytes, a character each; a byte-level one begins with the space before it."""
        text = key.encode("latin-1").decode()
        if self.kind == "bytes" and text[0] == " ":
            return self._new(text[1:], " ")
        return self._new(text, "")

    def _joined(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of plain byte-level runs, by few calls of the library."""
        groups = _BREAK.join(_BETWEEN.join(runs[i : i + GROUP]) + _BETWEEN for i in range(0, len(runs), GROUP))
        signs = _SIGNS_OF_BYTES[np.frombuffer(groups.encode("latin-1"), np.uint8)].tobytes().decode("utf-16-le")
        found = self.bare.encode_batch_fast(signs.split(chr(_SIGN_OF_BYTE[ord(_BREAK)])), add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
        ends = np.flatnonzero(ids == self.between)
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.between]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of other pieces, one at a time."""
        lists = list(map(self._raw, pieces))
        return np.array([len(x) >> 2 for x in lists], np.int64), np.frombuffer(b"".join(lists), "<u4")

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each different piece or run among the known ones, to which those that are new are added."""
        data, at = column(pieces)
        known = self.known
        if known.pieces.n >= self.entries or known.pieces.begin[known.pieces.n] > BYTES_EACH * self.entries:
            self.known = Known()
        out, first = np.zeros(len(at) - 1, np.int64), 0
        while first < len(out):
            to = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
            out[first:to] = self._some(data[at[first] : at[to]], at[first : to + 1] - at[first])
            first = to
        return out

    def _some(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of different pieces (offsets at) of about CHUNK bytes, or of one that is longer."""
        short, size = np.minimum(at, CHUNK), np.diff(at)
        h = range_hash(rolled(data[:CHUNK]), short[:-1], short[1:])
        out = self.known.find(h, data, at)
        new = out < 0
        if not new.any():
            return out
        plain = new & (self._strange(data, _kinds(data), at) == 0) if self.bare else np.zeros(len(new), bool)
        text = data.tobytes().decode("latin-1")  # a character a byte
        for some, encode in ((plain, self._joined), (new & ~plain, self._each)):
            if some.any():
                keys = [text[a:b] for a, b in zip(at[:-1][some].tolist(), at[1:][some].tolist(), strict=True)]
                out[some] = self.known.add(h[some], size[some], data[np.repeat(some, size)], *encode(keys))
        return out

    def _kind(self) -> str:
        """How the text is normalised and split: the kinds are fixed values of the library's description."""
        normalizer, split = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        level = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex="
        words = r"""Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True"""
        if normalizer == "None" and split == f"{level}True)":
            return "bytes"
        if "NFC(), Replace(" in normalizer and normalizer.endswith("Lowercase()])") and words in split and split.endswith(f"{level}False)])"):
            return "words"
        return ""

    def _encode(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, piece: str, before: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # one run, whose bytes stand for themselves
            run = (_SPACE + piece if before else piece) if self.kind == "bytes" else piece.lower()
            return self._packed([t.id for t in self.model.tokenize(run)])
        if not _PLAIN[self.kind].fullmatch(piece):
            return self._encode(before + piece)
        first, *rest = _RUNS[self.kind].findall(piece)
        if rest:
            return (self.rest if before else self.first)[first] + b"".join(map(self.first.__getitem__, rest))
        run = (before + piece) if self.kind == "bytes" else piece.lower()
        signs = run.encode().decode("latin-1").translate(_SIGN_OF_BYTE)
        return self._packed([t.id for t in self.model.tokenize(signs)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        for token in self.added:
            if token in text:
                return self._encode(text)
        if self.kind == "bytes":
            if "  " in text or " \n" in text or "\n " in text or (_OTHER_SPACE.search(text) and _UNEVEN.search(text)):
                return self._encode(text)
            head, *tail = text.split(" ")
            return (self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, tail))
        if self.kind != "words" or _ODD_SPACE.search(text):
            return self._encode(text)
        return b"".join(map(self.first.__getitem__, text.split()))


    def _whole(self, texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that ``ids`` has to look at: the split may not be neutral, or they hold an added token."""
        n = len(off) - 1
        if not self.kind:
            return np.ones(n, bool)
        out = np.zeros(n, bool)
        for token in self.added:
            out |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        plain = np.zeros(256, bool)
        plain[[0x20, 0x0A] if self.kind == "bytes" else _SEPARATORS["words"]] = True
        narrow = np.zeros(256, bool)
        narrow[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
        odd = [np.flatnonzero((narrow & ~plain)[data])]
        after = np.concatenate([data, np.zeros(2, np.uint8)])
        for first, rest in _WIDE_SPACES.items():
            at = np.flatnonzero(data == first)
            for tail in rest if len(at) else []:
                hit = np.ones(len(at), bool)
                for i, b in enumerate(tail, 1):
                    hit &= after[at + i] == b
                odd.append(at[hit])
        if self.kind == "bytes":
            space = np.flatnonzero(data == 0x20)
            beside = np.isin(after[space + 1], [0x20, 0x0A]) | ((space > 0) & (data[space - 1] == 0x0A))
            odd.append(space[beside])
            some = off[1:] > off[:-1]
            edge = np.concatenate([off[:-1][some], off[1:][some] - 1])
            odd.append(edge[data[edge] == 0x20])
        found = np.concatenate(odd)
        out[np.searchsorted(off, found, "right") - 1] = True
        return out

    @staticmethod
    def _strange(data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bytes of each piece (offsets at) are not plain, or line feeds behind another."""
        odd = kind == 0
        feed = np.flatnonzero(data == 0x0A)
        double = feed[1:][np.diff(feed) == 1]
        odd[double[np.searchsorted(at, double, "right") == np.searchsorted(at, double - 1, "right")]] = True
        return np.bincount(np.searchsorted(at, np.flatnonzero(odd), "right") - 1, minlength=len(at) - 1)

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the runs of plain pieces; a byte-level piece begins with the space before it."""
        n = len(data)
        kind = _kinds(data)
        begins = kind == _BLANK
        turns = np.zeros(n, bool)
        turns[1:] = (kind[1:] != kind[:-1]) & ~begins[:-1]
        begins[off[off < n]] = True
        start = np.flatnonzero(begins)
        turn = np.flatnonzero(turns)
        strange = self._strange(data, kind, np.append(start, n))
        begins[turn[strange[np.searchsorted(start, turn, "right") - 1] == 0]] = True
        return np.flatnonzero(begins)

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (rows + 1) and ids of all texts one after another, each with the end id behind it."""
        data, off = column(texts)
        n = len(off) - 1
        whole = self._whole(texts, data, off)
        if self.kind == "bytes":
            start = self._starts(data, off)
            stop = np.append(start[1:], len(data)) if len(start) else start
            flat = data
        else:
            separator = np.zeros(256, bool)
            separator[_SEPARATORS.get(self.kind, [])] = True
            start, stop, _ = words(data, off, separator)
            flat = data[~separator[data]]
        row = np.searchsorted(off, start, "right") - 1
        size = np.zeros(len(start) + 1, np.int64)
        np.cumsum(stop - start, out=size[1:])
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(flat)))
        keep = ~whole[row]
        pieces, row = (pieces, row) if keep.all() else (pieces.filter(pa.array(keep)), row[keep])
        known = pieces.dictionary_encode()
        del pieces, size, start, stop, flat, keep  # a long text's are large
        codes = self._numbers(known.dictionary)[known.indices.to_numpy(zero_copy_only=False)]
        held = self.known.ids
        last = held.put(np.ones(1, np.int64), np.array([end], "<u4"))
        # Every row's pieces, and then the end, which isn't kept.
        ends = np.searchsorted(row, np.arange(n), "right")
        after, ids = held.get(np.insert(codes, ends, last[0]))
        held.n -= 1
        off = np.concatenate([[0], after[ends + np.arange(1, n + 1)]])
        # Texts that are encoded whole come before their ends.
        parts, more, at = [], np.zeros(n + 1, np.int64), 0
        for i in np.flatnonzero(whole).tolist():
            own = np.frombuffer(self.ids(texts[i].as_py()), "<u4")
            parts += [ids[at : off[i + 1] - 1], own]
            more[i + 1], at = len(own), off[i + 1] - 1
        return (off + np.cumsum(more), np.concatenate([*parts, ids[at:]])) if parts else (off, ids)


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file."""
    lean(keep_tokenizer=True)
    key = (path, os.getpid())
    if key not in LOADED:
        LOADED[key] = PieceEncoder(path)
    return LOADED[key]
