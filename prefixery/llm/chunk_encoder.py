"""Whole-text encoding with a byte-level BPE of the ``tokenizers`` library.

The pre-tokenizer of these vocabularies never joins a space to what stands
before it, so a text falls apart without change of result before every space
that follows a character which is not white space.  It also falls apart between an
ASCII letter or digit and a punctuation mark, and on both sides of a line break that
something visible follows (white space but its last character is one piece there,
and a line break never joins what it precedes; before ``<`` not, since white space
that an added token follows is one piece), so that a word is one chunk whatever mark
or line comes after it.  The chunks between these points repeat a lot: each
distinct one is encoded once per worker (the new ones of a slice together, as a few
strings) and looked up by its 64-bit hash after that.

The cache has two generations.  When the younger one holds ``MAX_CHUNKS`` chunks or
``MAX_TOKENS`` tokens it becomes the older one and the older one goes; a chunk found in
the older one moves to the younger.  So memory is bounded (some 60 bytes a chunk, 4 a
token; a slice's new chunks come on top) and chunks that keep coming stay.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .arrowtext import Slice

MAX_CHUNKS = 250_000
MAX_TOKENS = 2_000_000
_JOIN = 500

_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(0x1C, 0x21)]] = True
_MARKS = ".,;:!?"
_MARK, _WORD, _SEEN = np.zeros((3, 256), bool)
_MARK[list(_MARKS.encode())] = True
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SEEN[0x21:0x7F] = True


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _blank_before(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position can be white space."""
    last = b[at - 1]
    wide = b[np.maximum(at - 3, 0)]
    # white space beyond ASCII: U+0085, U+00A0 and some three-byte characters led by E1..E3
    return _BLANK[last] | (((last == 0x85) | (last == 0xA0)) & (b[np.maximum(at - 2, 0)] == 0xC2)) | (
        (last >= 0x80) & (wide >= 0xE1) & (wide <= 0xE3))


def chunk_bounds(s: Slice, fine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each chunk, and the first chunk of each row (rows + 1)."""
    b = s.buf
    rows = s.off[:-1][np.diff(s.off) > 0]
    cut = np.zeros(len(b), bool)
    space = np.flatnonzero(b == 0x20)
    space = space[space > 0]
    cut[space[~_blank_before(b, space)]] = True
    if fine:
        mark = np.flatnonzero(_MARK[b])
        mark = mark[mark > 0]
        cut[mark[_WORD[b[mark - 1]]]] = True
        head = np.zeros(len(b), bool)
        head[rows] = True
        line = np.flatnonzero(b == 0x0A)
        line = line[line < len(b) - 1]
        line = line[_SEEN[b[line + 1]] & (b[line + 1] != ord("<")) & ~head[line + 1]]
        cut[line], cut[line + 1] = True, True
    cut[rows] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, s.off)


class _Generation:
    """Chunks by hash: open addressing in arrays (at most half full), and per chunk its
    tokens in flat arrays."""

    def __init__(self, flats: int):
        self.n, self.used = 0, 0
        self._room(1 << 16)
        self.first = np.zeros(1 << 15, np.int32)
        self.size = np.zeros(1 << 15, np.int32)
        self.flat = [np.zeros(1 << 17, np.uint32) for _ in range(flats)]

    def _room(self, slots: int) -> None:
        self.key, self.index = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.shift = np.uint64(64 - (slots.bit_length() - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each chunk, or -1."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> self.shift).astype(np.int64)
        left, last = np.arange(len(h)), len(self.key) - 1
        while len(left):
            key = self.key[at]
            hit = key == h
            out[left[hit]] = self.index[at[hit]]
            go = ~hit & (key != 0)
            left, h, at = left[go], h[go], (at[go] + 1) & last
        return out

    def _place(self, h: np.ndarray, index: np.ndarray) -> None:
        at, last = (h >> self.shift).astype(np.int64), len(self.key) - 1
        while len(h):
            free = self.key[at] == 0
            self.key[at[free]] = h[free]                    # of several for one place the last stays
            mine = self.key[at] == h
            self.index[at[mine]] = index[mine]
            h, index, at = h[~mine], index[~mine], (at[~mine] + 1) & last

    def add(self, h: np.ndarray, flat: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """New chunks with their tokens, one after another; returns their indexes."""
        n, more = self.n, len(flat[0])
        while n + len(h) > len(self.first):
            self.first, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.size))
        while self.used + more > len(self.flat[0]):
            self.flat = [np.concatenate([a, np.zeros_like(a)]) for a in self.flat]
        if 2 * (n + len(h)) > len(self.key):
            held = self.key != 0
            keys, index = self.key[held], self.index[held]
            self._room(1 << (4 * (n + len(h)) - 1).bit_length())
            self._place(keys, index)
        self.size[n:n + len(h)] = sizes
        self.first[n:n + len(h)] = self.used + np.cumsum(sizes) - sizes
        for have, new in zip(self.flat, flat, strict=True):
            have[self.used:self.used + more] = new
        index = np.arange(n, n + len(h), dtype=np.int32)
        self._place(h, index)
        self.n, self.used = n + len(h), self.used + more
        return index

    def tokens(self, index: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Flat tokens of chunks, and how many each has."""
        size = self.size[index].astype(np.int64)
        before = np.cumsum(size) - size
        pick = np.repeat(self.first[index] - before, size) + np.arange(int(size.sum()))
        return [a[pick] for a in self.flat], size


class ChunkEncoder:
    """``encode`` gives token ids; with ``offsets``, also the code points that
    each token covers in its text."""

    def __init__(self, path: str, offsets: bool = False):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        parts = vocabulary.get("pre_tokenizer") or {}
        if parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or vocabulary.get("normalizer"):
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        self.offsets = offsets
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)    # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.line = self.tokenizer.token_to_id("Ċ")
        # the finer cuts need added tokens that begin with "<" and hold no mark or line break
        self.fine = not any(t.get("lstrip") or t["content"][:1] != "<" or set(t["content"]) & set(_MARKS + "\n")
                            for t in vocabulary.get("added_tokens") or ())
        self.reset()

    def reset(self) -> None:
        flats = 3 if self.offsets else 1
        self.young, self.old = _Generation(flats), _Generation(flats)

    def _one(self, text: str) -> list[np.ndarray]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        out = [np.array(e.ids, np.uint32)]
        if self.offsets:
            span = np.array(e.offsets, np.uint32).reshape(-1, 2)
            out += [span[:, 0], span[:, 1]]
        return out

    def _singly(self, chunks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        ones = [self._one(c.decode("utf-8")) for c in chunks]
        return [np.concatenate(c) for c in zip(*ones, strict=True)], np.array([len(o[0]) for o in ones])

    def _many(self, chunks: list[bytes], between: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        """Flat arrays and sizes of chunks that begin with their only space (nothing
        ``between``), or that line breaks can stand between."""
        flat, sizes = [], []
        run = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        groups = [chunks[k:k + _JOIN] for k in range(0, len(chunks), _JOIN)]
        for group, e in zip(groups, run([between.join(g).decode("utf-8") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            own = np.ones(len(ids), bool)
            if between:
                own = ids != self.line
                breaks = np.flatnonzero(~own)
                first = np.append(0, breaks - np.arange(len(breaks)))
            else:
                first = np.flatnonzero(self.opens[ids])
            if len(first) != len(group) or first[0]:   # a special token's string can hide a chunk's first token
                one, size = self._singly(group)
                flat.append(one)
                sizes.append(size)
                continue
            size = np.diff(np.append(first, int(own.sum())))
            one = [ids[own]]
            if self.offsets:
                length = np.array([len(c.decode("utf-8")) + len(between) for c in group])
                begin = np.repeat(np.cumsum(length) - length, size)
                span = np.array(e.offsets, np.int64).reshape(-1, 2)[own] - begin[:, None]
                one += [span[:, 0].astype(np.uint32), span[:, 1].astype(np.uint32)]
            flat.append(one)
            sizes.append(size)
        return [np.concatenate(c) for c in zip(*flat, strict=True)], np.concatenate(sizes)

    def _encoded(self, s: Slice, starts: np.ndarray, ends: np.ndarray):
        """The chunks' places among the given ones, flat arrays and sizes, by kind of chunk."""
        b, raw = s.buf, s.buf.tobytes()

        def count(spots: np.ndarray) -> np.ndarray:
            return np.searchsorted(spots, ends) - np.searchsorted(spots, starts)

        usual = count(np.flatnonzero((b[:-1] == ord("<")) & (b[1:] == ord("|")))) == 0
        spaced = usual & (b[starts] == 0x20) & (ends - starts > 1) & (count(np.flatnonzero(b == 0x20)) == 1)
        bare = usual & _SEEN[b[starts]] & ~_blank_before(b, ends) & (count(np.flatnonzero(b == 0x0A)) == 0)
        if self.line is None:
            bare[:] = False
        for kind, work in ((spaced, lambda c: self._many(c, b"")), (bare, lambda c: self._many(c, b"\n")),
                           (~spaced & ~bare, self._singly)):
            at = np.flatnonzero(kind)
            if len(at):
                yield at, *work([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

    def _known(self, s: Slice, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index in the younger generation of each chunk of the slice."""
        if self.young.n >= MAX_CHUNKS or self.young.used >= MAX_TOKENS:
            self.young, self.old = _Generation(len(self.young.flat)), self.young
        index = self.young.find(h)
        missing = np.flatnonzero(index < 0)
        if not len(missing):
            return index
        keys, where, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
        found, place = np.full(len(keys), -1, np.int32), missing[where]
        if self.old.n:
            again = self.old.find(keys)
            at = np.flatnonzero(again >= 0)
            if len(at):
                found[at] = self.young.add(keys[at], *self.old.tokens(again[at]))
        new = np.flatnonzero(found < 0)
        if len(new):
            for at, flat, sizes in self._encoded(s, starts[place[new]], ends[place[new]]):
                found[new[at]] = self.young.add(keys[new[at]], flat, sizes)
        index[missing] = found[inverse]
        return index

    def encode(self, s: Slice) -> tuple[list[np.ndarray], np.ndarray]:
        """The slice's tokens as flat arrays (ids; with offsets, first code point
        and end in the row's text) and each row's first token (rows + 1)."""
        starts, row_first = chunk_bounds(s, self.fine)
        ends = np.append(starts[1:], len(s.buf))[:len(starts)]
        h = s.hashes(starts, ends)
        h[h == 0] = 1                                       # 0 marks a free place
        index = self._known(s, h, starts, ends)             # may begin a new generation
        out, size = self.young.tokens(index)
        before = np.cumsum(size) - size
        if self.offsets:
            point = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
            row = np.repeat(np.arange(s.n), np.diff(row_first))
            begin = np.repeat(point[starts] - point[s.off[:-1]][row], size)
            out[1], out[2] = out[1] + begin, out[2] + begin
        return out, np.append(before, int(size.sum()))[row_first]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, offsets: bool = False) -> ChunkEncoder:
    """This worker's encoder; kept between tasks."""
    key = (path, offsets)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, offsets)
    return _encoders[key]
