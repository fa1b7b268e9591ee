"""Cross-entropy difference: two bigram models over one vocabulary score each document.

The target model counts the target documents, the background model all documents; both have the same order, smoothing
and vocabulary: all words of the documents, and one unknown word.  A document's score is the mean,
over its words, of the target model's loss less the background model's: the lower, the more it is like the target.
A document is scored by the counts of the others: its own are left out of both models.

Counting and look-up are one exchange: a block sends each of its bigrams and words once with its counts, and gets the
totals back in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .decontam import LOWER, WORD

SCORES = "doc_id long, n_words long, loss_target double, loss_background double, score double"


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each word, and the word bounds of the texts."""
    data, off = B.buffer(column)
    data = LOWER[data]
    start, end = B.spans(WORD[data], off)
    return B.word_symbols(data, start, end), np.searchsorted(start, off)


def word_counts(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Value (w) and count (n) of each word of all texts.

    A task adds up its words in arrays of at most about twice `most` entries before they are sent.
    """
    B.small_batches(docs.sparkSession)

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending, size = [], 0

        def merged():
            parts = [(keys, counts), *pending]
            k, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(back, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)

        def rows():
            return pa.record_batch({"w": pa.array(keys.view(np.int64), pa.int64()), "n": pa.array(counts, pa.int64())})

        for whole in batches:
            for b in B.pieces(whole, "text", 2 << 20):
                pending.append(np.unique(_words(b.column("text"))[0], return_counts=True))
                size += len(pending[-1][0])
                if size > most // 2:
                    keys, counts = merged()
                    pending, size = [], 0
                    if len(keys) > most:
                        yield rows()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield rows()

    return docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary: int) -> np.ndarray:
    """Sorted values of the most frequent words of all texts; ties go to the smaller value."""
    top = word_counts(docs).orderBy(F.desc("n"), "w").limit(vocabulary).collect()  # bounded by the vocabulary
    return np.sort(np.array([r["w"] for r in top], np.int64).view(np.uint64))


#: Odd multipliers of the keys of bigrams and of words, and values that no word has but by chance.
_PAIR, _WORD = (np.uint64(x) for x in B.BASES)
_START, _UNKNOWN, _TOTAL = (np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0x8EBC6AF09C88C6E3))


class Keys:
    """64-bit keys of bigrams, words and contexts from the words' values; words outside `words`, if given, are one unknown word."""

    def __init__(self, size: int, words: np.ndarray | None = None):
        self.size, self.words = size, words

    def ids(self, values: np.ndarray) -> np.ndarray:
        if self.words is None:
            return values
        if not len(self.words):
            return np.full(len(values), _UNKNOWN)
        at = np.minimum(np.searchsorted(self.words, values), len(self.words) - 1)
        return np.where(self.words[at] == values, values, _UNKNOWN)

    def asked(self, column) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """For each word the keys of its bigram, itself, its context (how often the word before stands before another:
        all words do but the last of a text) and the number of words; and the bounds of the texts."""
        values, bounds = _words(column)
        ids = self.ids(values)
        before = np.r_[_START, ids[:-1]][: len(ids)]
        first = bounds[:-1]
        before[first[first < len(ids)]] = _START
        pair = B.mixed(B.mixed(before * _PAIR) + ids)
        return {"pair": pair, "word": B.mixed(ids * _WORD), "context": B.mixed(before * _WORD), "total": np.full(len(ids), _TOTAL)}, bounds


def _short(values: np.ndarray, kind: type) -> bytes:
    """Counts as small unsigned integers; the greatest of these stands for a count that follows, with its place."""
    top = np.iinfo(kind).max
    large = np.flatnonzero(values >= top)
    return B.pack(np.minimum(values, top).astype(kind), large.astype(np.uint32), values[large].astype(np.int64))


def _full(body: bytes, kind: type) -> tuple[np.ndarray, bytes]:
    """The counts that a body begins with, and the rest of it."""
    low, place, large = B.unpack(body, kind, np.uint32, np.int64)
    out = low.astype(np.int64)
    out[place] = large
    return out, body[24 + low.nbytes + place.nbytes + large.nbytes :]


def _zipped(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unzipped(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def _coded(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as 48 bits of the distance from the one before; distances that need more follow in full."""
    step = np.diff(keys, prepend=np.uint64(0))
    large = np.flatnonzero(step >> np.uint64(48))
    low = step.view(np.uint8).reshape(-1, 8)[:, :6]  # little-endian
    return B.pack(low.ravel(), large.astype(np.uint32), step[large])


def _decoded(body: bytes) -> tuple[np.ndarray, bytes]:
    low, place, large = B.unpack(body, np.uint8, np.uint32, np.uint64)
    step = np.zeros((len(low) // 6, 8), np.uint8)
    step[:, :6] = low.reshape(-1, 6)
    step = step.view(np.uint64).ravel()
    step[place] = large
    return np.cumsum(step, dtype=np.uint64), body[24 + low.nbytes + place.nbytes + large.nbytes :]


class Local:
    """A block's sorted keys in two runs, bigrams and words: each with counts, a word also with those as a context."""

    def __init__(self, keys: Keys, column):
        asked, self.bounds = keys.asked(column)
        self.pairs, self.pair = np.unique(asked["pair"], return_inverse=True)
        n = len(self.pair)
        self.words, back = np.unique(np.concatenate([asked["word"], asked["context"], asked["total"][:1]]), return_inverse=True)
        self.word, self.context, self.total = back[:n], back[n : 2 * n], np.repeat(back[2 * n :], n if n else 0)

    def counts(self, weight: np.ndarray | None = None) -> list[np.ndarray]:
        """Of bigrams, of words, and of words as contexts."""
        count = lambda at, size: np.bincount(at, weight, size).astype(np.int64)
        words = count(self.word, len(self.words)) + count(self.total, len(self.words))
        return [count(self.pair, len(self.pairs)), words, count(self.context, len(self.words))]

    def cuts(self, buckets: int) -> list[np.ndarray]:
        """Bounds of the buckets in both runs."""
        of = lambda k: ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return [np.searchsorted(of(k), np.arange(buckets + 1, dtype=np.uint64)) for k in (self.pairs, self.words)]


def _requests(g: int, buckets: int, keys: Keys, t: pa.Table, target: np.ndarray) -> pa.Table:
    """One row per bucket with a block's keys and their background and target counts, and one that brings back which
    rows are targets."""
    local = Local(keys, t["text"])
    every, some = local.counts(), local.counts(np.repeat(target, np.diff(local.bounds)))
    pairs, words = local.cuts(buckets)
    dest, bodies = [], []
    for b in np.flatnonzero((np.diff(pairs) > 0) | (np.diff(words) > 0)).tolist():
        cut = [slice(c[b], c[b + 1]) for c in (pairs, words, words)]
        dest.append(b)
        counts = b"".join(_short(n[c], np.uint8) for counts in (every, some) for n, c in zip(counts, cut, strict=True))
        bodies.append(_coded(local.pairs[cut[0]]) + _coded(local.words[cut[1]]) + _zipped(counts))
    kinds = [B.ASK] * len(bodies) + [B.STATE]
    dest, bodies = [*dest, g % buckets], [*bodies, np.packbits(target).tobytes()]
    return pa.table({"dest": pa.array(dest, pa.int64()), "src": pa.array([g] * len(bodies), pa.int64()), "kind": pa.array(kinds, pa.int32()), "body": pa.array(bodies, pa.binary())})


def _totals(t: pa.Table) -> pa.Table:
    """Sums of a bucket's counts, sent back to every block that asked: background sums only where they aren't the block's own count."""
    runs, counts = ([], []), tuple([] for _ in range(6))
    asks, bodies = np.flatnonzero(t["kind"].to_numpy() == B.ASK).tolist(), t["body"].to_pylist()
    for i in asks:
        body = bodies[i]
        for run in runs:
            k, body = _decoded(body)
            run.append(k)
        body = _unzipped(body)
        for c in counts:
            n, body = _full(body, np.uint8)
            c.append(n)
    replies = [b""] * len(asks)
    solved = []
    for run in runs if asks else ():
        unique, back = np.unique(np.concatenate(run), return_inverse=True)
        solved.append((len(unique), back, np.r_[0, np.cumsum([len(k) for k in run])].tolist()))
    for c, parts in enumerate(counts if asks else ()):
        size, back, at = solved[min(c % 3, 1)]
        sums = np.bincount(back, np.concatenate(parts), size).astype(np.int64)
        for i, (own, a, z) in enumerate(zip(parts, at[:-1], at[1:], strict=True)):
            total = sums[back[a:z]]
            if c < 3:
                other = total != own
                bits = np.packbits(other)
                replies[i] += B.pack(bits) + _short(total[other], np.uint16)
            else:
                replies[i] += _short(total, np.uint8)
    for i, reply in zip(asks, replies, strict=True):
        bodies[i] = _zipped(reply)
    return pa.table({"g": t["src"].cast(pa.int64()), "dest": t["dest"].cast(pa.int64()), "kind": t["kind"].cast(pa.int32()), "body": pa.array(bodies, pa.binary())})


def _received(local: Local, buckets: int, t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Background and target totals of a block's keys, as Local.counts() has them, and which rows are targets."""
    target = np.zeros(len(local.bounds) - 1, bool)
    every = local.counts()
    some = [np.zeros_like(n) for n in every]
    pairs, words = local.cuts(buckets)
    for b, kind, body in zip(t["dest"].to_pylist(), t["kind"].to_pylist(), t["body"].to_pylist(), strict=True):
        if kind == B.STATE:
            target = np.unpackbits(np.frombuffer(body, np.uint8), count=len(target)).astype(bool)
            continue
        body, cut = _unzipped(body), [slice(c[b], c[b + 1]) for c in (pairs, words, words)]
        for n, c in zip(every, cut, strict=True):
            (bits,) = B.unpack(body, np.uint8)
            values, body = _full(body[8 + len(bits) :], np.uint16)
            n[c][np.unpackbits(bits, count=c.stop - c.start).astype(bool)] = values
        for n, c in zip(some, cut, strict=True):
            n[c], body = _full(body, np.uint8)
    return every, some, target


def _own(row: np.ndarray, key: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, as numbers in order, and how often each occurs."""
    return np.unique(row * np.int64(max(keys, 1)) + key, return_counts=True)


def _times(own: tuple[np.ndarray, np.ndarray], row: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """How often each (row, key) occurs, by what _own() has counted."""
    if not len(own[0]):
        return np.zeros(len(row), np.int64)
    wanted = row * np.int64(max(keys, 1)) + key
    at = np.minimum(np.searchsorted(own[0], wanted), len(own[0]) - 1)
    return np.where(own[0][at] == wanted, own[1][at], 0)


def losses(n: dict[str, np.ndarray], size: int, strength: float) -> np.ndarray:
    """-log p(word | word before): the bigram's share, smoothed with `strength` words of the add-one unigram model."""
    alone = (n["word"] + 1) / (n["total"] + size)
    return -np.log((n["pair"] + strength * alone) / (n["context"] + strength))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, strength: float = 100.0, block_bytes: int = 3 << 20, leave_out: bool = True) -> DataFrame:
    """Scores documents (doc_id, text; other columns are ignored): doc_id, n_words, loss_target, loss_background, score.

    target_ids (doc_id) names the target documents.  Losses are means over the words, in nats.  Texts without words, and
    null, have null losses and score.  A row without doc_id is background and is scored.  Repeated rows count, and are
    scored, each.  Without target documents the target model is the uniform one that its smoothing leaves.
    A row's own counts are left out of the models that score it, unless leave_out is False; those of a row that repeats
    it stay.  All words are counted; `vocabulary` makes all but that many of the most frequent ones a single unknown word.
    """
    spark = docs.sparkSession
    B.small_batches(spark)
    if vocabulary is None:
        keys = Keys(word_counts(docs).count() + 1)
    else:
        words = frequent_words(docs, vocabulary)
        keys = Keys(len(words) + 1, words)
    n = B.spread(docs)
    blocks = max(n, -(-B.input_bytes(docs) // max(block_bytes, 16 * n)))
    block = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks))).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).alias("g")
    dealt = docs.select(block, "doc_id", "text").repartition(n, "g")
    wanted = target_ids.select("doc_id").where("doc_id is not null").distinct().select(block_of_ids(blocks), "doc_id").repartition(n, "g")
    buckets = n

    def count(key: tuple[pa.Scalar, ...], t: pa.Table, ids: pa.Table) -> pa.Table:
        g = key[0].as_py() if key[0].as_py() is not None else 0
        if not len(t):
            return pa.table({"dest": pa.array([], pa.int64()), "src": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        mine = t["doc_id"].is_valid().to_numpy() & np.isin(t["doc_id"].fill_null(-1).to_numpy(), ids["doc_id"].to_numpy())
        return _requests(g, buckets, keys, t, mine)

    def score(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        local = Local(keys, t["text"])
        bounds = local.bounds
        size, loss = np.diff(bounds), []
        every, some, target = _received(local, buckets, replies)
        row = np.repeat(np.arange(len(size)), size)
        own = {}
        if leave_out:
            m = len(local.words)
            own = {"pair": _times(_own(row, local.pair, len(local.pairs)), row, local.pair, len(local.pairs)), "word": _times(_own(row, local.word, m), row, local.word, m), "context": _times(_own(row, local.context, m), row, local.context, m), "total": size[row]}
        for (pairs, words, contexts), mine in ((every, np.ones(len(row), bool)), (some, target[row])):  # background, then target
            n = {"pair": pairs[local.pair], "word": words[local.word], "context": contexts[local.context], "total": words[local.total]}
            each = losses({k: v - own[k] * mine if own else v for k, v in n.items()}, keys.size, strength)
            sums = np.r_[0, np.cumsum(each)]
            loss.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(size, 1))
        none = size == 0
        column = lambda x: pa.array(x, pa.float64(), mask=none)
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_words": pa.array(size, pa.int64()), "loss_target": column(loss[1]), "loss_background": column(loss[0]), "score": column(loss[1] - loss[0])})

    sent = dealt.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(count, B.REQUEST)
    replies = sent.repartition(buckets, "dest").groupBy("dest").applyInArrow(_totals, B.REPLY).repartition(n, "g")
    return dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(score, SCORES)


def block_of_ids(blocks: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("g")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """cross_entropy_difference() of documents; the target documents are those that labels call good (quality 1)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"))
    return out.select("doc_id", "n_words", *(F.round(c, 8).alias(c) for c in ("loss_target", "loss_background", "score")))
