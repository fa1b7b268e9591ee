"""Byte-level BPE over blocks of text.

Texts are cut into pretokens by array operations over the characters' classes, and the ids of a pretoken are looked up
in a table that each Python worker fills as it goes, by a hash of 63 bits, a second one of 64 and its length; only
pretokens seen for the first time are merged one by one.  The ids equal those that the tokenizer file gives with ``add_special_tokens=False``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property

import numpy as np

from . import blocks as B

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that a lone apostrophe takes along, as in the published pattern of this kind of tokenizer.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The published pattern itself, for texts that take the slow way.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CLASSES: np.ndarray | None = None
_LOADED: dict[str, BlockTokenizer] = {}


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[WHITE_SPACE] = SPACE
        _CLASSES = t
    return _CLASSES


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand
    for themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pretokens in bytes, and for each text the number of pretokens before it."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character begins
    edge = np.searchsorted(at, off)
    first = np.zeros(n + 1, bool)
    first[edge] = True
    kind = _classes()[chars]
    blank = kind == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    new = (kind != before) | first[:-1]
    plain_before = np.zeros(n, bool)  # a literal space just before, in the same text
    plain_before[1:] = chars[:-1] == 0x20
    plain_before[first[:-1]] = False
    start = new & (blank | ~plain_before)
    last = np.zeros(n, bool)  # the last white space before something else
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:-1]
    start |= last
    quote = np.flatnonzero((chars == 0x27) & new & ~plain_before)
    if len(quote):
        end = edge[np.searchsorted(edge, quote, side="right")]
        for ending in ENDINGS:
            q = quote[quote + len(ending) < end]
            for i, c in enumerate(ending):
                q = q[chars[q + 1 + i] == ord(c)]
            start[q + 1] = False
            if len(ending) == 2:
                start[q + 2] = False
            stop = q + 1 + len(ending)
            start[stop[stop < n]] = True
    where = np.flatnonzero(start)
    return at[where], np.searchsorted(where, edge)


class BlockTokenizer:
    """Ids of whole blocks of texts.  Its memory is bounded by `most` cached pretokens."""

    def __init__(self, path: str, most: int = 600_000):
        spec = json.load(open(path, encoding="utf-8"))
        self.vocab, self.path = spec["model"]["vocab"], path
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.piece = self._merger(spec)
        self.most, self.bits = most, 21
        size = 1 << self.bits
        self.hash, self.second, self.place, self.length = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 20, np.uint32), 0, 0
        self.evicted: dict[bytes, tuple[int, int]] = {}

    @cached_property
    def slow(self):
        """The tokenizer itself, for texts with a special token's string."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def literal(self):
        """The same, to which such a string is ordinary text."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _merger(self, spec: dict):
        """A function from a pretoken's bytes to ids: by ranks where the ids are in the order of the merges."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer with its usual pattern is needed")
        ranks = {bytes(letters[c] for c in token): i for token, i in self.vocab.items() if token not in self.special}
        if all(self.vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)) and sorted(ranks.values()) == list(range(len(ranks))):
            import tiktoken

            fast = tiktoken.Encoding("block", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda raw: fast.encode_ordinary(raw.decode("utf-8", "replace"))
        return lambda raw: self.literal.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _room(self, n: int) -> None:
        if self.used + n > len(self.pool):
            pool = np.zeros(2 * max(len(self.pool), self.used + n), np.uint32)
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool

    def _learn(self, key: np.ndarray, second: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of the ids of pretokens that the table doesn't have."""
        _, one, back = np.unique(key ^ B.mixed(second), return_index=True, return_inverse=True)
        place, length = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        fresh = []
        for i, (a, z) in enumerate(zip(start[one].tolist(), end[one].tolist(), strict=True)):
            have = self.evicted.get(raw[a:z])
            if have is None:
                ids = self.piece(raw[a:z])
                self._room(len(ids))
                self.pool[self.used : self.used + len(ids)] = ids
                have = (self.used, len(ids))
                self.used += len(ids)
                fresh.append(i)
            place[i], length[i] = have
        if fresh and self.count < self.most:
            self.count += len(fresh)
            f = np.array(fresh)
            slot = (key[one[f]] & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            free = self.hash[slot] == 0
            free[free] = np.isin(np.flatnonzero(free), np.flatnonzero(free)[np.unique(slot[free], return_index=True)[1]])
            g, at = f[free], slot[free]
            self.hash[at], self.second[at], self.place[at], self.length[at] = key[one[g]], second[one[g]], place[g], length[g]
            for i in f[~free].tolist():
                self.evicted[raw[start[one[i]] : end[one[i]]]] = (int(place[i]), int(length[i]))
        return place[back], length[back]

    def encode(self, data: np.ndarray, off: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offset of each text in them.

        special: whether a special token's string inside a text gets that token's id, as the tokenizer does unless told
        otherwise; such texts take the slow way.
        """
        raw = data.tobytes()
        odd: dict[int, np.ndarray] = {}
        if special:
            for s in self.special:
                i, mark = raw.find(s.encode()), s.encode()
                while i >= 0:
                    doc = int(np.searchsorted(off, i, side="right")) - 1
                    text = raw[off[doc] : off[doc + 1]]
                    if doc not in odd and mark in text:
                        odd[doc] = np.array(self.slow.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                    i = raw.find(mark, i + 1)
        used, count = self.used, self.count
        start, before = pretokens(data, off)
        end = np.r_[start[1:], len(data)]
        key = B.word_symbols(data, start, end) | np.uint64(1)
        second = B.word_symbols(data, start, end, B.BASES[1])
        slot = (key & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        place, length = self.place[slot].astype(np.int64), self.length[slot].astype(np.int64)
        miss = np.flatnonzero((self.hash[slot] != key) | (self.second[slot] != second))
        if len(miss):
            place[miss], length[miss] = self._learn(key[miss], second[miss], start[miss], end[miss], raw)
        total = np.r_[0, np.cumsum(length)]
        ids = self.pool[np.repeat(place - total[:-1], length) + np.arange(total[-1])]
        bounds = total[before]
        if count >= self.most:  # what the full table could not keep
            self.used = used
        if odd:
            parts = [odd.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(off) - 1)]
            ids, bounds = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, bounds


def tokenizer(path: str) -> BlockTokenizer:
    if path not in _LOADED:
        _LOADED[path] = BlockTokenizer(path)
    return _LOADED[path]
