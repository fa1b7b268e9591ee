"""Repeats across documents: windows of a fixed number of symbols that also start in a document with a smaller id.

Documents meet on winnowed anchors: every window has one, chosen by its content alone, so equal windows have the same
anchor at the same place.  Around anchors that several documents share the match is extended both ways, in steps that
each send few keys and no pairs:

1. anchors: which occur in several documents;
2. the whole stretch whose windows belong to the anchor: its least document settles all copies of the stretch at once,
   and one copy of each stretch goes on;
3. groups of eight windows by the symbols that all eight share: which can still be equal to another stretch's;
4. the windows of those groups: the least document of each.

No step lists the members of a group: a block sends every key once, with the least of its documents.

Symbols are words (``substring``) or bytes (``suffix_array``).  For bytes, a hash-compared suffix sort of each block
decides which stretches (step 2) and which windows (step 4) are equal; matches are verified byte by byte, and one of
each class is sent.  Between blocks, byte strings are compared by a 64-bit hash and 32 bits of a BLAKE2 digest of
their bytes, word sequences by two hashes that share no word value.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .suffixes import Suffixes

SPACE = B.byte_table([0x20, *range(0x09, 0x0E)])
GROUP = 8
LONGEST = 1 << 20


@dataclass(frozen=True)
class Repeats:
    """window: symbols of a window (1 to LONGEST); k: symbols of an anchor (a longer one is cut to the window)."""

    words: bool
    window: int
    k: int

    def __post_init__(self):
        if not (1 <= self.window <= LONGEST and self.k >= 1):
            raise ValueError(f"a window has 1 to {LONGEST} symbols, and an anchor at least 1")
        object.__setattr__(self, "k", min(self.k, self.window))

    @property
    def group(self) -> int:
        return min(GROUP, self.window)

    @property
    def offset(self) -> str:
        """The type of an anchor's distance from the beginning of a window."""
        return "u1" if self.window - self.k < 1 << 8 else "u4"



class Block:
    """Documents of a block in id order.  Rows without an id come last and match nothing."""

    def __init__(self, t: pa.Table, how: Repeats):
        self.how, self.table = how, t
        self.data, self.off = B.buffer(t["text"])
        self.known = len(t) - t["doc_id"].null_count
        self.ids = np.asarray(t["doc_id"].slice(0, self.known).to_numpy(), np.int64)
        if how.words:
            self.start, self.end = B.spans(~SPACE[self.data], self.off)
            self.all_bounds = np.searchsorted(self.start, self.off)
            symbols = B.word_symbols(self.data, self.start, self.end)
        else:
            self.all_bounds = self.off
            symbols = B.BYTE_SYMBOLS[self.data]
        self.bounds = self.all_bounds[: self.known + 1]
        self.symbols = symbols[: int(self.bounds[-1])]
        self.rolling = B.Rolling(self.symbols)

    def doc(self, place: np.ndarray) -> np.ndarray:
        """Ids of the documents at symbol places."""
        return self.ids[np.searchsorted(self.bounds, place, side="right") - 1] if len(place) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        place, first, last = B.anchors(self.rolling, self.bounds, self.how.window, self.how.k)
        return place, first, last, self.rolling.slices(place, place + self.how.k)

    def classes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Equal slices: a slice of each class in the order that they are sent in, its two keys, and the class of each."""
        if self.how.words:
            first = self.rolling.slices(start, end)
            second = B.Rolling(B.word_symbols(self.data, self.start, self.end, B.BASES[1]), B.BASES[1]).slices(start, end)
            order, new, group = _distinct(first, second)
            return order[new], first[order[new]], second[order[new]], group
        order, new, group = _distinct(Suffixes(self.data, start, end - start, self.rolling).classes())
        one, raw = order[new], self.data.tobytes()
        first = self.rolling.slices(start[one], end[one])
        names = (blake2b(raw[a:z], digest_size=8).digest() for a, z in zip(start[one].tolist(), end[one].tolist(), strict=True))
        second = np.frombuffer(b"".join(names), U)
        order, new, merged = _distinct(first, second)
        return one[order[new]], first[order[new]], second[order[new]], merged[group]

    def group(self, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
        """The class of each slice, of which `classes` were sent; what is slow to tell only if hashes fell together."""
        _, new, group = _distinct(self.rolling.slices(start, end))
        return group if len(new) == classes else self.classes(start, end)[3]


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of the groups in it, group of each entry) by the first key, then the others."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int32)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _flags(doc: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """1 for groups with several documents."""
    if not len(order):
        return np.zeros(0, np.uint8)
    d = doc[order]
    return (np.maximum.reduceat(d, start) != np.minimum.reduceat(d, start)).astype(np.uint8)


def _least_of(doc: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    least = np.full(groups, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    return least


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.uint32)


def _steps(how: Repeats):
    L, G = how.window, how.group

    def anchor_keys(g, t, _, buckets):
        b = Block(t, how)
        place, _, _, key = b.anchors()
        order, start, _ = _distinct(key)
        key = key[order][start]
        return B.requests(g, buckets, key, B.flagged(key, _flags(b.doc(place), order, start)), b"")

    def stretches(g, t, replies, buckets):
        b = Block(t, how)
        place, first, last, key = b.anchors()
        _, _, group = _distinct(key)
        shared = B.received(replies)[1][group]
        place, first, last = place[shared], first[shared], last[shared]
        one, k1, k2, group = b.classes(first, last + L)
        state = B.pack(_delta(place), (place - first).astype(how.offset), (place - last).astype(how.offset))
        return B.requests(g, buckets, k1, B.owned(k1, k2), state, _least_of(b.doc(place), group, len(one)))

    def pairs(place, low, high):
        """(anchor, group of eight offsets) for all offsets that anchors have."""
        a, z = low // G, high // G
        n = z - a + 1
        who = np.repeat(np.arange(len(place)), n)
        return who, a[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)

    def core_key(b, place, q):
        at = place - q * G
        return b.rolling.slices(at, at + L - G + 1) ^ B.mixed(q.astype(U) + U(1))

    def cores(g, t, replies, buckets):
        b = Block(t, how)
        state, beaten = B.received(replies)
        delta, high, low = B.unpack(state, "u4", how.offset, how.offset)
        place, high, low = np.cumsum(delta, dtype=np.int64), high.astype(np.int64), low.astype(np.int64)
        doc = b.doc(place)
        done = _settled(beaten, b.group(place - high, place - low + L, len(beaten)), doc)
        covered = _union(place[done] - high[done], place[done] - low[done] + L)
        place, low, high, doc = place[~done], low[~done], high[~done], doc[~done]
        who, q = pairs(place, low, high)
        key = core_key(b, place[who], q)
        order, start, _ = _distinct(key)
        state = B.pack(*covered, _delta(place), high.astype(how.offset), low.astype(how.offset))
        key = key[order][start]
        return B.requests(g, buckets, key, B.flagged(key, _flags(doc[who], order, start)), state)

    def windows(g, t, replies, buckets):
        b = Block(t, how)
        state, flag = B.received(replies)
        begin, end, delta, high, low = B.unpack(state, "i4", "i4", "u4", how.offset, how.offset)
        place, low, high = np.cumsum(delta, dtype=np.int64), low.astype(np.int64), high.astype(np.int64)
        who, q = pairs(place, low, high)
        live = flag[_distinct(core_key(b, place[who], q))[2]]
        who, q = who[live], q[live]
        a, z = np.maximum(low[who], q * G), np.minimum(high[who], q * G + G - 1)
        n = z - a + 1
        at = np.repeat(place[who] - a, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        one, k1, k2, group = b.classes(at, at + L)
        return B.requests(g, buckets, k1, B.owned(k1, k2), B.pack(begin, end, _delta(at)), _least_of(b.doc(at), group, len(one)))

    several, beaten = B.answered(("u4", "u2"), B.several), B.answered(("u8", "u4"), B.beaten, valued=True)
    return [(anchor_keys, several), (stretches, beaten), (cores, several), (windows, beaten)]


def _settled(beaten: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries for which a smaller document has the same: in another block, or in this one."""
    return beaten[group] | (_least_of(doc, group, len(beaten))[group] < doc)


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as disjoint ones in order."""
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(begin, kind="stable")
    a, z = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
    return a[new].astype(np.int32), z[np.r_[new[1:] - 1, len(a) - 1]].astype(np.int32)


def removed(t: pa.Table, replies: pa.Table, how: Repeats) -> tuple[Block, np.ndarray]:
    """The block and, for each of its symbols, whether a window that a smaller document has too covers it."""
    b = Block(t, how)
    state, beaten = B.received(replies)
    begin, end, delta = B.unpack(state, "i4", "i4", "u4")
    at = np.cumsum(delta, dtype=np.uint32).astype(np.int64)  # differences modulo 2**32
    hit = at[_settled(beaten, b.group(at, at + how.window, len(beaten)), b.doc(at))]
    depth = np.zeros(int(b.all_bounds[-1]) + 1, np.int32)
    for a, z in ((begin.astype(np.int64), end.astype(np.int64)), (hit, hit + how.window)):
        np.add.at(depth, a, 1)
        np.add.at(depth, z, -1)
    return b, np.cumsum(depth[:-1]) > 0


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _kept_words(b: Block, gone: np.ndarray) -> list[bytes]:
    out = []
    raw, bounds, some = b.data.tobytes(), b.all_bounds.tolist(), _sums(gone, b.all_bounds).tolist()
    for i, (a, z) in enumerate(zip(b.off[:-1].tolist(), b.off[1:].tolist(), strict=True)):
        words = raw[a:z].split()
        out.append(b" ".join(compress(words, (~gone[bounds[i] : bounds[i + 1]]).tolist()) if some[i] else words))
    return out


def _kept_bytes(b: Block, gone: np.ndarray) -> list[bytes]:
    kept = b.data[~gone].tobytes()
    at = np.r_[0, np.cumsum(np.diff(b.off) - _sums(gone, b.off))].tolist()
    return [kept[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def _run(docs: DataFrame, how: Repeats, final, schema: str, block_bytes: int, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    B.small_batches(spark)
    n = B.spread(docs)
    extra, full = B.widened_schema(docs, schema, keep)

    def last(g, t, replies):
        out = final(g, t, replies)
        for c in extra:
            out = out.append_column(c, t[c])
        return out

    return B.converse(B.grouped(docs, block_bytes, n, extra), n, n, _steps(how), last, full)


def substring_dedup(docs: DataFrame, window: int = 50, k: int = 16, block_bytes: int = 1 << 18, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Removes every word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    docs needs doc_id and text; of other columns those in keep are carried along.  A window has 1 to 2**20 symbols.
    Returns for each row doc_id, n_words, n_removed and kept
    (the kept words joined by one space).  Null and empty texts have no words; a row whose doc_id is null matches
    nothing and keeps all its words; rows that share a doc_id do not shorten each other, and each gives a row.  An
    empty table gives an empty result.  A text shorter than a window is kept.
    """
    how = Repeats(True, window, k)

    def final(g, t, replies):
        b, gone = removed(t, replies, how)
        kept = [x.decode("utf-8", "surrogatepass") for x in _kept_words(b, gone)]
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_words": pa.array(np.diff(b.all_bounds), pa.int64()), "n_removed": pa.array(_sums(gone, b.all_bounds), pa.int64()), "kept": pa.array(kept, pa.string())})

    return _run(docs, how, final, "doc_id long, n_words long, n_removed long, kept string", block_bytes, keep)


def suffix_array_dedup(docs: DataFrame, length: int = 50, k: int = 20, block_bytes: int = 1 << 18, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Removes every byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    docs needs doc_id and text; of other columns those in keep are carried along.  A string has 1 to 2**20 bytes.
    Returns for each row doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs) and kept (binary: the remaining bytes, which need not be valid UTF-8).  A null text is an
    empty one; rows with a null doc_id match nothing; rows that share a doc_id do not shorten each other, and each
    gives a row.  An empty table gives an empty result.
    """
    how = Repeats(False, length, k)

    def final(g, t, replies):
        b, gone = removed(t, replies, how)
        begin, _ = B.spans(gone, b.off)
        runs = np.diff(np.searchsorted(begin, b.off))
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_bytes": pa.array(np.diff(b.off), pa.int64()), "n_removed": pa.array(_sums(gone, b.off), pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(_kept_bytes(b, gone), pa.binary())})

    return _run(docs, how, final, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", block_bytes, keep)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """suffix_array_dedup() of documents with strings of 50 bytes; the kept bytes as their digest."""
    out = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """substring_dedup() of documents with windows of 50 words; the kept words as their digest."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
