"""SimHash near-duplicates: fingerprints, links by multi-index hashing, and components.

Two fingerprints of 64 bits that differ in at most `bits` places differ in at most bits // segments places in one of
`segments` parts of them.  Each distinct fingerprint is filed under its parts, and looks up all values in the small
Hamming ball around each part; whole distances are verified in the join.  Copies of a fingerprint are one node.
Fingerprints first meet two representatives of their own entries; later only those of different components meet.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components

SEED = 42


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[s : s + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words of the text in lower case, words joined by one space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    end = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    start = np.r_[0, end[:-1] + 1].tolist()
    end = end.tolist()
    if len(words) > shingle:
        start, end = start[: 1 - shingle or None], end[shingle - 1 :]
    else:
        start, end = start[:1], end[-1:]
    return np.array([h(flat[a:z], SEED) for a, z in zip(start, end, strict=True)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fingerprint (fp, a signed long) of each row.  Texts without words, and null, have fingerprint zero."""
    B.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, off = B.buffer(b.column("text"))
            raw, at = data.tobytes(), off.tolist()
            fp = np.array([fingerprint(shingle_hashes(raw[a:z], shingle)) for a, z in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "fp": pa.array(fp.view(np.int64), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _parts(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments of 64 bits."""
    cut = [64 * i // segments for i in range(segments + 1)]
    return [(a, z - a) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def fewest_rows(nodes: int, bits: int) -> int:
    """The number of segments with which `nodes` fingerprints look up, and find, the fewest table rows: at most one for
    each bit that may differ, so that there is a ball to look up."""

    def rows(segments: int) -> float:
        width, radius = 64 // segments, bits // segments
        return segments * sum(math.comb(width, r) for r in range(radius + 1)) * (1 + nodes / 2.0**width)

    return min(range(1, max(bits, 1) + 1), key=rows)


def _part(low: int, width: int):
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _filed(nodes: DataFrame, segments: int) -> DataFrame:
    """Table entries (seg, val) of the nodes, with their columns."""
    return reduce(DataFrame.union, (nodes.select(F.lit(i).alias("seg"), _part(*at).alias("val"), *nodes.columns) for i, at in enumerate(_parts(segments))))


def _asked(nodes: DataFrame, bits: int, segments: int) -> DataFrame:
    """Keys (seg, val) that the nodes look up: the balls around their parts."""
    asked = []
    for i, (low, width) in enumerate(_parts(segments)):
        masks = F.array(*(F.lit(m).cast("long") for m in _ball(width, bits // segments)))
        balls = nodes.select(_part(low, width).alias("own"), F.explode(masks).alias("mask"), *nodes.columns)
        asked.append(balls.select(F.lit(i).alias("seg"), F.col("own").bitwiseXOR(F.col("mask")).alias("val"), *nodes.columns))
    return reduce(DataFrame.union, asked)


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, bits: int = 4, segments: int = 3) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column fp) that differ in at most `bits` bits: all of them, which
    for a dense group are many.  near_duplicates() does without."""
    nodes = nodes.select("fp")
    probe, table = _asked(nodes, bits, segments).alias("p"), _filed(nodes, segments).alias("t")
    on = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val")) & (F.col("p.fp") < F.col("t.fp")) & (_differ("p.fp", "t.fp") <= bits)
    return probe.join(table, on).select(F.col("p.fp").alias("u"), F.col("t.fp").alias("v"))


def represented(nodes: DataFrame, bits: int, segments: int) -> DataFrame:
    """Links (u, v) of fingerprints (column fp) with two representatives of each of their own entries, the least and the
    greatest fingerprint there: this links most of a dense group without its pairs."""
    filed = _filed(nodes.select("fp"), segments)
    ends = B.stored(filed.groupBy("seg", "val").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high"))
    near = filed.join(ends, ["seg", "val"]).select("fp", F.explode(F.array("low", "high")).alias("end"))
    near = near.where((F.col("fp") != F.col("end")) & (_differ("fp", "end") <= bits))
    return near.select(F.least("fp", "end").alias("u"), F.greatest("fp", "end").alias("v")).distinct()


def apart(rooted: DataFrame, bits: int, segments: int) -> DataFrame:
    """Pairs (u, v) of roots that a link joins, for fingerprints with a rank (a component's size and root).

    Of two components the lower rank asks, so the members of an entry's highest leave it alone, and an entry that holds
    one component only is looked at by others alone.
    """
    table = _filed(rooted, segments)
    highest = table.groupBy("seg", "val").agg(F.max("rank").alias("highest"))
    open_ = _asked(rooted, bits, segments).join(highest, ["seg", "val"]).where(F.col("rank") < F.col("highest")).alias("p")
    on = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val")) & (F.col("p.rank") < F.col("t.rank")) & (_differ("p.fp", "t.fp") <= bits)
    return open_.join(table.alias("t"), on).select(F.col("p.rank.root").alias("u"), F.col("t.rank.root").alias("v")).distinct()


def linked(nodes: DataFrame, bits: int, segments: int) -> DataFrame:
    """node and root of the distinct fingerprints (column fp) that links of at most `bits` bits join, but the roots."""
    few = B.stored(represented(nodes, bits, segments))
    found = components(few)
    rooted = nodes.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = found.groupBy("root").agg((F.count("*") + 1).alias("size"))  # of components of two or more
    rank = F.struct(F.coalesce("size", F.lit(1)).alias("size"), "root")
    rest = B.stored(apart(B.stored(rooted.join(sizes, "root", "left").select("fp", rank.alias("rank"))), bits, segments))
    return found if rest.isEmpty() else components(few.union(rest))


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, segments: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links of at most `bits` bits reach) of each row.

    docs needs doc_id and text; other columns are ignored.  Words are lower-cased in A-Z only.  Texts without words, and
    null, have fingerprint zero and are linked like any other.  A row without doc_id belongs to its component, which it
    never names; a component of such rows only has a null id.  Repeated rows each give a row.  Any number of segments
    gives the same result; without one it follows the number of fingerprints.  Pairs within a component that its
    representatives have joined are neither made nor asked for.
    """
    prints = B.stored(fingerprints(docs, shingle))
    nodes = B.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = linked(nodes, bits, segments or fewest_rows(nodes.count(), bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of documents, with the fingerprint in hexadecimal digits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
