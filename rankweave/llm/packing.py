"""Vector best-fit packing of token pieces into sequences.

An item is a vector of tokens, documents (one) and attention cost (tokens squared); a sequence has a capacity for each.
All three follow from an item's length, so the plan is made on the histogram of lengths, which has at most
``max_tokens`` entries whatever the corpus holds: lengths go from long to short, and sequences with the same residual
vector are one state with many members.  Among the states that hold the item under every constraint, the one with the
least weighted residual norm (or the greatest weighted dot product) takes it.  The plan's runs then give each piece
its sequence and offset by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .fasttok import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """A sequence's capacities; None leaves one unbounded.  cost is the sum of squared lengths.

    rule: 'norm' takes the least weighted residual norm, 'dot' the greatest weighted dot product of item and residual.
    A binding cost capacity is counted in `grid` steps, an item's share rounded up, which keeps the states few.
    """

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"
    grid: int = 256


def plan(counts: dict[int, int], cap: Capacity) -> np.ndarray:
    """Runs (length, first rank, items, first sequence, offset): item rank first + i lies in sequence first + i."""
    big = 1 << 40
    documents = cap.documents if cap.documents is not None and cap.documents < cap.tokens else None
    cost = cap.cost if cap.cost is not None and cap.cost < cap.tokens * cap.tokens else None
    unit = max(1, -(-cost // cap.grid)) if cost is not None else 1
    full = np.array([cap.tokens, documents or big, cost // unit if cost is not None else big], np.int64)
    weight = np.array(cap.weights) * np.array([1, documents is not None, cost is not None])
    states: dict[tuple[int, int, int], list[tuple[int, int, int]]] = defaultdict(list)  # residual -> [first, last, tokens]
    runs, opened = [], 0

    def score(residual: np.ndarray, item: np.ndarray) -> np.ndarray:
        r = residual / full
        if cap.rule == "dot":
            return -(r * (item / full) * weight).sum(1)
        return np.sqrt((((residual - item) / full) ** 2 * weight).sum(1))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        item = np.array([length, documents is not None, -(-length * length // unit) if cost is not None else 0], np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence")
        left, rank = counts[length], 0
        keys = np.array(list(states), np.int64).reshape(-1, 3)
        while left:
            fits = np.flatnonzero((keys >= item).all(1)) if length else np.zeros(0, int)
            if len(fits):
                s = score(keys[fits], item)
                best = fits[np.lexsort((keys[fits][:, 2], keys[fits][:, 1], keys[fits][:, 0], s))[0]]
                residual = keys[best]
                members = states[tuple(residual.tolist())]
            else:
                residual, members = full, None
            each = int(min(r // i for r, i in zip(residual.tolist(), item.tolist(), strict=True) if i)) if length else left
            wanted, last = (left // each, 0) if left >= each else (1, left)
            n = last or each
            if members is None:
                begin, end, offset = opened, opened + wanted, 0
                opened = end
            else:
                begin, end, offset = members.pop()
                if end - begin > wanted:
                    members.append((begin + wanted, end, offset))
                    end = begin + wanted
                if not members:
                    del states[tuple(residual.tolist())]
                    keys = np.delete(keys, best, 0)
            m = end - begin
            for j in range(n):
                runs.append((length, rank, m, begin, offset + j * length))
                rank += m
            left -= n * m
            now = tuple((residual - n * item).tolist())
            if now[0] > 0:
                if now not in states:
                    keys = np.vstack([keys, np.array(now, np.int64)])
                states[now].append((begin, end, offset + n * length))
    return np.array(runs, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of the documents' ids, each document followed by end_id: doc_id, piece, start, length, ids_crc32.

    A document of more than max_tokens ids is cut into pieces of max_tokens, of which the first may be shorter.  A null
    text is an empty one, so every row has a piece; an empty table has none.
    """
    B.small_batches(docs.sparkSession)

    def cut(batches):
        for whole in batches:
            for batch in B.pieces(whole, "text", 1 << 20):
                data, off = B.buffer(batch.column("text"))
                ids, bounds = tokenizer(tokenizer_path).encode(data, off)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")  # an id after each document
                bounds = bounds + np.arange(len(bounds))
                total = np.diff(bounds)
                short = total % max_tokens
                pieces = total // max_tokens + (short > 0)
                who = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lead = np.where(short > 0, short, max_tokens)[who]
                start = np.where(piece > 0, lead + (piece - 1) * max_tokens, 0)
                length = np.where(piece > 0, max_tokens, lead)
                raw, at = memoryview(ids).cast("B"), (bounds[who] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(who)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
        B.release()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:  # noqa: B008
    """Adds sequence_id and offset to pieces (columns of PIECES, each length from 1 to cap.tokens).

    Pieces of one length are interchangeable in the plan; which of them lies where follows their doc_id, piece and
    checksum.  The pieces are written to the shared folder first, as their ranks have to be the same each time.
    """
    spark = pieces.sparkSession
    pieces = B.stored(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most cap.tokens rows
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs = plan(counts, cap)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    salts = max(4 * B.partitions(spark), sum(counts.values()) // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn")).alias("rank"))

    def place(batches):
        key = (runs[:, 0] << 44) | runs[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = runs[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*out, pa.array(run[:, 3] + rank - run[:, 1], pa.int64()), pa.array(run[:, 4], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, cap: Capacity = Capacity(), end_id: int = 0) -> DataFrame:  # noqa: B008
    """Tokenizes documents (doc_id, text; other columns are ignored) and packs their pieces into sequences."""
    return best_fit(token_pieces(docs, tokenizer_path, cap.tokens, end_id), cap)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: What a training sequence holds.  2048 tokens imply the other two: a piece has a token at least, and the squares of
#: lengths add up to no more than the square of their sum.  plan() leaves out what can't bind.
PRODUCTION = Capacity(tokens=2048, documents=2048, cost=2048 * 2048)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """pack_documents() of documents into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file(), PRODUCTION)
