"""Benchmark decontamination by winnowing.

Of the k-gram hashes in each window of words the least is kept.  Documents and benchmark choose alike, so a window that
both hold brings the same fingerprint in both: fingerprints of the documents that the benchmark has too are hits, and a
hit is extended to its whole windows, which are compared by two independent hashes.  Every shared window is found.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U

WORD = B.byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PART = "doc_id long, __hash__ long, n_words long, hit binary, items array<string>"
FILTER_BITS = 20


class Words:
    """The lower-cased words of texts as symbols."""

    def __init__(self, column: pa.Array):
        data, off = B.buffer(column)
        data = LOWER[data]
        start, end = B.spans(WORD[data], off)
        self.bounds = np.searchsorted(start, off)
        self.first = B.Rolling(B.word_symbols(data, start, end))
        self.second = B.Rolling(B.word_symbols(data, start, end, B.BASES[1]), B.BASES[1])  # shares no word value

    def keys(self, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.first.slices(start, start + n), self.second.slices(start, start + n)


@dataclass
class Lookup:
    """Windows of one length: sorted keys, their second hashes, and the items (ids) of each."""

    size: int
    key: np.ndarray
    second: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    maybe: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, size: int, key: np.ndarray, second: np.ndarray, item: np.ndarray) -> Lookup:
        order = np.lexsort((item, second, key))
        key, second, item = key[order], second[order], item[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]) if len(key) else np.zeros(0, np.int64)
        return cls(size, key[new], second[new], np.r_[new, len(key)], item, _filter(key))

    def find(self, key: np.ndarray, second) -> tuple[np.ndarray, np.ndarray]:
        """(place, entry) of the keys that are windows; second(places) gives their second hashes."""
        place = np.flatnonzero(self.maybe[key >> U(64 - FILTER_BITS)])
        entry = np.searchsorted(self.key, key[place])
        hit = entry < len(self.key)
        hit[hit] = self.key[entry[hit]] == key[place][hit]
        place, entry = place[hit], entry[hit]
        same = self.second[entry] == second(place) if len(place) else np.zeros(0, bool)
        return place[same], entry[same]


def _filter(key: np.ndarray) -> np.ndarray:
    t = np.zeros(1 << FILTER_BITS, bool)
    t[key >> U(64 - FILTER_BITS)] = True
    return t


class Index:
    """A benchmark's windows: fingerprints and whole windows of `window` words, and the short items, by length."""

    def __init__(self, ids: list, texts: list[str | None], window: int, k: int):
        self.window, self.k = window, k
        w = Words(pa.array(texts, pa.string()))
        self.names, item = np.unique(np.array([str(i) for i in ids], object), return_inverse=True)
        n, item = np.diff(w.bounds), item.astype(np.int64)
        place, first, last = B.anchors(w.first, w.bounds, window, k)
        self.prints = np.unique(w.first.slices(place, place + k))
        self.maybe = _filter(self.prints)
        start = np.repeat(first, last - first + 1) + _within(last - first + 1)
        self.long = Lookup.of(window, *w.keys(start, window), item[np.searchsorted(w.bounds, start, side="right") - 1])
        self.short = []
        for size in np.unique(n[(n > 0) & (n < window)]).tolist():
            whole = np.flatnonzero(n == size)
            self.short.append(Lookup.of(size, *w.keys(w.bounds[whole], size), item[whole]))

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word bounds of the texts, hit words (booleans), and the pairs (text, item's name) that share a window."""
        w = Words(column)
        depth, docs, items = np.zeros(int(w.bounds[-1]) + 1, np.int32), [], []

        def take(lookup: Lookup, start: np.ndarray, entry: np.ndarray) -> None:
            np.add.at(depth, start, 1)
            np.add.at(depth, start + lookup.size, -1)
            n = lookup.bounds[entry + 1] - lookup.bounds[entry]
            docs.append(np.repeat(np.searchsorted(w.bounds, start, side="right") - 1, n))
            items.append(lookup.items[np.repeat(lookup.bounds[entry], n) + _within(n)])

        if len(self.prints):
            place, first, last = B.anchors(w.first, w.bounds, self.window, self.k)
            key = w.first.slices(place, place + self.k)
            some = np.flatnonzero(self.maybe[key >> U(64 - FILTER_BITS)])
            some = some[np.isin(key[some], self.prints)]  # the join of fingerprints
            n = last[some] - first[some] + 1
            start = np.repeat(first[some], n) + _within(n)  # extended to the windows they stand for
            at, entry = self.long.find(w.first.slices(start, start + self.window), lambda p: w.second.slices(start[p], start[p] + self.window))
            take(self.long, start[at], entry)
        for lookup in self.short:
            m = lookup.size
            start = np.arange(max(0, int(w.bounds[-1]) - m + 1))
            at, entry = lookup.find(w.first.slices(start, start + m), lambda p, m=m: w.second.slices(p, p + m))
            inside = w.bounds[np.searchsorted(w.bounds, at, side="right")] >= at + m
            take(lookup, at[inside], entry[inside])
        pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.int64), *items])]), axis=1)
        return w.bounds, np.cumsum(depth[:-1]) > 0, pairs[0], self.names[pairs[1]]


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n-1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _names(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _verdict(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, block_bytes: int = 16 << 20, keep: list[str] = [], masks: bool = False) -> DataFrame:  # noqa: B006
    """What of each document (doc_id, text) is in a benchmark (item_id, text): columns of RESULT.

    masks adds the column `hit`, the hit words as packed bits, or null without any; without_hits() cuts them.

    Words are runs of ASCII letters and digits and of all characters above ASCII, lower-cased in A-Z.  Items shorter
    than a window are windows of their own; items without words or without an id match nothing; an id may be of any type.  Null texts have no
    words.  Each row gives a row, with the columns in keep; other columns are ignored.

    The benchmark goes to the tasks in blocks of about block_bytes of text.  One block is the usual case and needs no
    shuffle; a larger benchmark makes a pass over the documents for each block, and the parts are put together.
    """
    spark = docs.sparkSession
    B.small_batches(spark)
    benchmark = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    result = f"{RESULT}, hit binary" if masks else RESULT
    extra, schema = B.widened_schema(docs, result, keep)
    if blocks == 1:
        docs = docs.select("doc_id", "text", *(c for c in extra if c != "text"))
        return docs.mapInArrow(_whole(_index(benchmark, window, k), extra, masks), schema)
    row = F.xxhash64("text", F.spark_partition_id())  # equal rows of different input partitions meet apart
    parts = [docs.select("doc_id", "text", row.alias("__hash__")).mapInArrow(_part(_index(benchmark.where(block == i), window, k)), PART) for i in range(blocks)]
    found = reduce(DataFrame.union, parts).groupBy("doc_id", "__hash__").applyInArrow(_joined(blocks, masks), f"{result}, __hash__ long")
    if not extra:
        return found.drop("__hash__")
    found = found.dropDuplicates(["doc_id", "__hash__"]).withColumnRenamed("doc_id", "__found__")
    docs = docs.select("doc_id", row.alias("__key__"), *extra)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found__"]) & F.col("__key__").eqNullSafe(F.col("__hash__"))).select([f.name for f in schema])


def _index(benchmark: DataFrame, window: int, k: int) -> Index:
    rows = benchmark.collect()  # block_bytes of text at most, about
    return Index([r["item_id"] for r in rows], [r["text"] for r in rows], window, k)


def _rows(bounds, hit, doc, item):
    total = np.r_[0, np.cumsum(hit)]
    n_hit = total[bounds[1:]] - total[bounds[:-1]]
    cut = np.searchsorted(doc, np.arange(len(bounds)))
    return np.diff(bounds), n_hit, [item[a:z].tolist() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _table(ids, n_words, n_hit, items) -> dict:
    return {
        "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array([_names(x) for x in items], pa.string()),
        "contaminated": pa.array([_verdict(a, b) for a, b in zip(n_words, n_hit, strict=True)], pa.bool_()),
    }


def _whole(index: Index, extra: list[str], masks: bool):
    def run(batches):
        for whole in batches:
            for b in B.pieces(whole, "text", 2 << 20):
                bounds, hit, doc, item = index.hits(b.column("text"))
                n_words, n_hit, items = _rows(bounds, hit, doc, item)
                table = _table(b.column("doc_id").cast(pa.int64()), n_words.tolist(), n_hit.tolist(), items)
                if masks:
                    table["hit"] = pa.array([np.packbits(hit[a:z]).tobytes() if n else None for a, z, n in zip(bounds[:-1], bounds[1:], n_hit, strict=True)], pa.binary())
                yield pa.record_batch(table | {c: b.column(c) for c in extra})

    return run


def _part(index: Index):
    def run(batches):
        for whole in batches:
            for b in B.pieces(whole, "text", 2 << 20):
                bounds, hit, doc, item = index.hits(b.column("text"))
                n_words, _, items = _rows(bounds, hit, doc, item)
                masks = [np.packbits(hit[a:z]).tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "__hash__": b.column("__hash__"), "n_words": pa.array(n_words, pa.int64()), "hit": pa.array(masks, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))})

    return run


def _joined(blocks: int, masks: bool):
    def run(t: pa.Table) -> pa.Table:
        n = t["n_words"][0].as_py()
        hit = np.zeros(-(-n // 8), np.uint8)
        for m in t["hit"].to_pylist():
            hit |= np.frombuffer(m, np.uint8)
        items, copies = sorted(set().union(*t["items"].to_pylist())), len(t) // blocks
        table = _table(t["doc_id"].slice(0, copies), [n] * copies, [int(np.unpackbits(hit).sum())] * copies, [items] * copies)
        if masks:
            table["hit"] = pa.array([hit.tobytes() if hit.any() else None] * copies, pa.binary())
        return pa.table(table | {"__hash__": t["__hash__"].slice(0, copies)})

    return run


def without_hits(found: DataFrame) -> DataFrame:
    """found (text, hit and other columns) with the hit words, and what follows each up to the next word, cut from text."""
    B.small_batches(found.sparkSession)

    def kept(text: str, mask: bytes) -> str:
        data = np.frombuffer(text.encode(), np.uint8)
        start, _ = B.spans(WORD[LOWER[data]], np.array([0, len(data)]))
        cut = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=len(start)))
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, start[cut], 1)
        np.add.at(change, np.r_[start[1:], len(data)][cut], -1)
        return data[np.cumsum(change[:-1]) == 0].tobytes().decode()

    def run(batches):
        for b in batches:
            texts = [t if m is None else kept(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("hit").to_pylist(), strict=True)]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """decontaminate() of documents by the whole benchmark."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
