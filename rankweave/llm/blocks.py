"""Shared machinery: text blocks as flat byte buffers, rolling hashes, winnowing, and exchanges of packed keys.

A *block* is a bounded number of whole documents laid end to end.  Keys leave a block as sorted arrays, split by
their leading bits into buckets, so that the data which crosses the network has one row per (block, bucket) and not
one per key.  Every block sends a key at most once per round, so a key that a third of the corpus holds costs its
bucket one entry per block.
"""

from __future__ import annotations

import ctypes
import math
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import removed, scratch  # noqa: F401

U = np.uint64
#: Odd multipliers of the two rolling hashes, and the constants that scramble a finished hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

REQUEST = "dest long, src long, kind int, body binary"
REPLY = "g long, dest long, kind int, body binary"
ASK, STATE = 0, 1
BLOCK = "__block__"
#: An estimate that the optimizer makes up for tables without files, at least; and input for a partition, at most.
UNKNOWN_BYTES, PARTITION_BYTES = 1 << 50, 64 << 20
_RELEASED = 0.0
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: The size, as stored or shuffled, up to which a table that grows with the input may go through the driver.
BROADCAST_BYTES = 256 << 10


# ---------------------------------------------------------------- storage


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Sets a runtime setting for the time of a job, and puts the caller's back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the cut in the lineage outlives any executor.

    What the job shuffled goes as soon as it has ended.
    """
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lowers the bound on an Arrow batch's rows to `rows`, so that a batch of long texts stays small; never raises it."""
    now = int(spark.conf.get(BATCH_ROWS))
    if not 0 < now <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Lowers the size up to which the jobs that run meanwhile send a join's side through the driver; never raises it.

    The driver holds such a side as rows, as a table and as blocks: dozens of times its size as shuffled.
    """
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with ExitStack() as stack:
        for key in (BROADCAST, adaptive):
            now = spark.conf.get(key, None)
            if now is not None and (now.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BROADCAST_BYTES):
                continue
            if now is not None or key == BROADCAST:
                stack.enter_context(setting(spark, key, str(BROADCAST_BYTES)))
        yield


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that a caller runs: if its files are larger than that, it doesn't go through the driver."""
    return df.hint("merge") if input_bytes(df) > BROADCAST_BYTES else df


def release(every: float = 0.5) -> None:
    """Gives the system back what this worker has freed, now and then: workers stay, and wait for other tasks with what
    they hold."""
    global _RELEASED
    if time.monotonic() - _RELEASED < every:
        return
    _RELEASED = time.monotonic()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The size of the input's files, by the optimizer's estimate; where it knows none, that of the texts."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < UNKNOWN_BYTES else df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def spread(df: DataFrame) -> int:
    """Partitions, and buckets, of an exchange over df: the session's number, or more where they would get too large."""
    return max(partitions(df.sparkSession), -(-input_bytes(df) // PARTITION_BYTES))


def widened_schema(docs: DataFrame, schema: str, keep: list[str]) -> tuple[list[str], T.StructType]:
    """Columns of docs to carry along, and the result's schema with them; a name that the result has is not carried."""
    own = T._parse_datatype_string(schema)
    extra = [c for c in keep if c not in own.names]
    return extra, T.StructType([*own.fields, *(docs.schema[c] for c in extra)])


# ---------------------------------------------------------------- buffers


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds, data = column.buffers()[1:]
    off = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; a longer document is a slice of its own."""
    lengths = np.diff(buffer(batch.column(column))[1])
    at = 0
    while at < len(lengths):
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def byte_table(members: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes; no run crosses a row's end."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    after[-1], after[:-1] = False, member[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge], after[edge - 1] = False, False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


# ---------------------------------------------------------------- hashes

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(MIX[0])
    x ^= x >> U(33)
    x *= U(MIX[1])
    x ^= x >> U(33)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size, out = max(1 << 12, 1 << math.ceil(math.log2(max(n, 2)))), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        have = (out[0], out[1])
        if size <= 1 << 23:  # what an unusually long text needs is not kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


class Rolling:
    """Prefix polynomial hashes modulo 2**64: the hash of any slice of the symbols in constant time."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        up, self.down = _powers(base, n + 1)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(symbols * up[:n], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end))


BYTE_SYMBOLS = mixed(np.arange(1, 257, dtype=U) * U(BASES[1]))


def word_symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit value for each word, which depends on its bytes and their number; another base gives another value."""
    return mixed(Rolling(BYTE_SYMBOLS[data], base).raw(start, end) + (end - start).astype(U) * U(MIX[0]))


# ---------------------------------------------------------------- winnowing


def _runs(raw: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose least k-gram of w is the same: (place, first start, last start); of equal ones the leftmost.

    The choice depends on content alone.  40 leading bits of a sort key hold the hash, 24 the place.
    """
    n, step, out = len(raw) - w + 1, (1 << 24) - w, []
    for at in range(0, n, step):
        m = min(step, n - at)
        key = (raw[at : at + m + w - 1] & U(0xFFFFFFFFFF000000)) | np.arange(m + w - 1, dtype=U)
        span = 1
        while 2 * span <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if rest := w - span:
            key = np.minimum(key[:-rest], key[rest:])
        new = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        out.append(((key[new] & U(0xFFFFFF)).astype(np.int64) + at, new + at, np.r_[new[1:], m] - 1 + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors(rolling: Rolling, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors of texts that lie end to end between bounds: (place, first window, last window).

    Every window of `window` symbols within one text belongs to exactly one anchor: its least k-gram.
    """
    n = int(bounds[-1])
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e, e
    raw = (rolling.prefix[k : n + 1] - rolling.prefix[: n - k + 1]) * rolling.down[: n - k + 1]
    place, first, last = _runs(raw, window - k + 1)
    text = np.searchsorted(bounds, place, side="right") - 1
    first = np.maximum(first, bounds[text])  # windows over a text's start or end belong to none
    last = np.minimum(last, bounds[text + 1] - window)
    whole = np.flatnonzero(first <= last)
    return place[whole], first[whole], last[whole]


# ---------------------------------------------------------------- exchanges of packed keys


def grouped(docs: DataFrame, block_bytes: int, n: int, extra: list[str]) -> DataFrame:
    """documents dealt over blocks (column BLOCK) of about block_bytes of input, several to a partition.

    Equal rows of different input partitions go to different blocks.  A block holds at least as many bytes as there are
    partitions, so that the rows it sends don't outnumber its keys.
    """
    more = [c for c in extra if c != "text"]
    blocks = max(n, -(-input_bytes(docs) // max(block_bytes, 16 * n)))
    place = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    return docs.select(place.alias(BLOCK), "doc_id", "text", *more).repartition(n, BLOCK)


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the buckets in sorted 64-bit keys, for buckets that get any: (bucket, bounds)."""
    bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return bucket[start].astype(np.int64), np.r_[start, len(keys)]


def narrow(values: np.ndarray) -> bytes:
    """64-bit values as 32-bit distances from the least one, if they allow it."""
    base = int(values.min()) if len(values) else 0
    if len(values) and int(values.max()) - base >= 1 << 32:
        return b"\0" + values.astype(np.int64).tobytes()
    return b"\1" + base.to_bytes(8, "little", signed=True) + (values - base).astype(np.uint32).tobytes()


def widened(body: bytes) -> np.ndarray:
    if body[0]:
        return np.frombuffer(body, np.uint32, offset=9).astype(np.int64) + int.from_bytes(body[1:9], "little", signed=True)
    return np.frombuffer(body[1:], np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(body: bytes, *dtypes: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(body, np.int64, len(dtypes)), 8 * len(dtypes), []
    for n, kind in zip(sizes.tolist(), dtypes, strict=True):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def owned(key: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Columns of sorted keys: 96 bits of two hashes."""
    return [key, (second >> U(32)).astype(np.uint32)]


def requests(g: int, buckets: int, keys: np.ndarray, columns: list[np.ndarray], state: bytes, values: np.ndarray | None = None) -> pa.Table:
    """One row per bucket with its slice of the columns, in the order of the sorted keys, and one that brings the state back."""
    dest, bounds = split(keys, buckets)
    last = (lambda a, b: narrow(values[a:b])) if values is not None else lambda a, b: b""
    bodies = [pack(*(c[a:b] for c in columns)) + last(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.table({"dest": pa.array([*dest.tolist(), g % buckets], pa.int64()), "src": pa.array([g] * (len(bodies) + 1), pa.int64()), "kind": pa.array([ASK] * len(bodies) + [STATE], pa.int32()), "body": pa.array([*bodies, state], pa.binary())})


def _entries(body: bytes, dtypes: tuple[str, ...], valued: bool) -> list[np.ndarray]:
    out = unpack(body, *dtypes)
    return [*out, widened(body[8 * len(dtypes) + sum(c.nbytes for c in out) :])] if valued else out


def answered(dtypes: tuple[str, ...], solve: Callable[..., np.ndarray], valued: bool = False) -> Callable[[pa.Table], pa.Table]:
    """What a bucket sends back: solve(owner, *columns) over all blocks' entries gives a bit for each entry."""

    def answer(t: pa.Table) -> pa.Table:
        kind, src, body = t["kind"].to_numpy(), t["src"].to_pylist(), t["body"].to_pylist()
        asks = np.flatnonzero(kind == ASK).tolist()
        replies = dict(enumerate(body))
        if asks:
            parts = [_entries(body[i], dtypes, valued) for i in asks]
            sizes = [len(p[0]) for p in parts]
            out = solve(np.repeat(np.arange(len(parts), dtype=np.int32), sizes), *(np.concatenate(c) for c in zip(*parts, strict=True)))
            for i, piece in zip(asks, np.split(out, np.cumsum(sizes)[:-1]), strict=True):
                replies[i] = len(piece).to_bytes(4, "little") + np.packbits(piece).tobytes()
        out = pa.table({"g": pa.array(src, pa.int64()), "dest": t["dest"].cast(pa.int64()), "kind": pa.array(kind, pa.int32()), "body": pa.array([replies[i] for i in range(len(src))], pa.binary())})
        del body, replies
        release()
        return out

    return answer


def received(t: pa.Table) -> tuple[bytes, np.ndarray]:
    """The state and the answers (booleans) of a block, in the order of the keys that it sent."""
    kinds, dest, body = t["kind"].to_pylist(), t["dest"].to_pylist(), t["body"].to_pylist()
    state = next((b for k, b in zip(kinds, body, strict=True) if k == STATE), b"")
    rows = sorted((d, b) for k, d, b in zip(kinds, dest, body, strict=True) if k == ASK)
    bits = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")) for _, b in rows]
    return state, np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def flagged(key: np.ndarray, flag: np.ndarray) -> list[np.ndarray]:
    """Sorted keys cut to 48 bits in two columns; the last bit is the flag.  What falls together is told apart later."""
    low = ((key >> U(16)) & U(0xFFFE)).astype(np.uint16) | flag
    return [(key >> U(32)).astype(np.uint32), low]


def several(owner: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """1 for entries whose flagged key has entries of two blocks or a flag (uint8)."""
    key, flag = (high.astype(U) << U(16)) | (low & 0xFFFE), low & 1
    order = np.argsort(key, kind="stable")
    k, f = key[order], flag[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])
    many = np.maximum.reduceat(f, start) > 0
    several = np.flatnonzero(size > 1)
    o = owner[order]
    many[several] |= np.maximum.reduceat(o, start)[several] != np.minimum.reduceat(o, start)[several]
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(many, size)
    return out


def beaten(owner: np.ndarray, key: np.ndarray, second: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 for entries with a greater value than another entry with the same pair of keys (uint8)."""
    order = np.lexsort((second, key))
    k, s, v = key[order], second[order], value[order]
    start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    out = np.empty(len(key), np.uint8)
    out[order] = v > np.repeat(np.minimum.reduceat(v, start), np.diff(np.r_[start, len(k)]))
    return out


def converse(docs: DataFrame, n: int, buckets: int, steps: list[tuple[Callable, Callable]], final: Callable, schema: T.StructType) -> DataFrame:
    """Rounds in which every block sends keys to buckets and gets a value back for each, then the blocks' results.

    docs has the columns BLOCK, doc_id, text and is partitioned by BLOCK; all rounds reuse that one exchange of the texts.
    A step is (emit, answer): emit(g, block, replies or None, buckets) -> requests table; final(g, block, replies) -> rows.
    """
    replies: DataFrame | None = None
    for emit, answer in steps:
        if replies is None:
            sent = docs.groupBy(BLOCK).applyInArrow(_first(emit, buckets), REQUEST)
        else:
            sent = docs.groupBy(BLOCK).cogroup(replies.groupBy("g")).applyInArrow(_later(emit, buckets), REQUEST)
        replies = sent.repartition(buckets, "dest").groupBy("dest").applyInArrow(answer, REPLY).repartition(n, "g")
    return docs.groupBy(BLOCK).cogroup(replies.groupBy("g")).applyInArrow(_last(final), schema)


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _first(emit, buckets):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = emit(key[0].as_py(), _ordered(t), None, buckets)
        release()
        return out

    return run


def _later(emit, buckets):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        out = emit(key[0].as_py(), _ordered(t), replies, buckets)
        release()
        return out

    return run


def _last(final):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        out = final(key[0].as_py(), _ordered(t), replies)
        release()
        return out

    return run
