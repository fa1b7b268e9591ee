"""Exact nearest vectors by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import DIGITS, ranked

#: Bytes of query vectors that go to the tasks at once; more make another pass.  A task takes BLOCK of them at a time.
PASS_BYTES, BLOCK = 64 << 20, 1024


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], cap: int) -> DataFrame:
    """query_id, source_id, score and pos of each query's `cap` most similar vectors (source_id, v).

    Similarity is 1 less the cosine distance, in double precision, rounded; ties go to the smaller id.  A vector of
    another length than the query's, or of length zero, is no candidate.  Each batch sends on its best `cap` rows of a
    query, so the shuffle doesn't grow with the table's rows but with its partitions.
    """
    out, step = None, max(1, PASS_BYTES // (8 * max([1, *(len(v) for _, v in queries)])))
    for at in range(0, max(1, len(queries)), step):
        part = vectors.select("source_id", "v").mapInArrow(_best(queries[at : at + step], cap), "query_id long, source_id string, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, [F.desc("score"), F.asc("source_id")], cap)


def _best(queries: list[tuple[int, list[float]]], cap: int):
    parts = [_block(queries[at : at + BLOCK], cap) for at in range(0, len(queries), BLOCK)]

    def run(batches):
        for b in batches:
            for part in parts:
                yield from part(b)

    return run


def _block(queries: list[tuple[int, list[float]]], cap: int):
    ids = np.array([q for q, _ in queries], np.int64)
    sizes = np.array([len(v) for _, v in queries], np.int64)

    def run(b):
        names, column = b.column("source_id"), b.column("v")
        length = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(length) - length
        for size in sorted(set(sizes.tolist())):
            rows, wanted = np.flatnonzero((length == size) & (size > 0)), np.flatnonzero(sizes == size)
            if not len(rows):
                continue
            m = flat[begin[rows][:, None] + np.arange(size)]
            q = np.array([queries[i][1] for i in wanted.tolist()], np.float64)
            norm = np.sqrt((m * m).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.round((m @ q.T) / norm, DIGITS)
            for j, i in enumerate(wanted.tolist()):
                s = score[:, j]
                ok = np.flatnonzero(~np.isnan(s))
                if len(ok) > cap:
                    ok = ok[s[ok] >= np.partition(s[ok], len(ok) - cap)[len(ok) - cap]]
                yield pa.record_batch({"query_id": pa.array(np.full(len(ok), ids[i]), pa.int64()), "source_id": names.take(pa.array(rows[ok])).cast(pa.string()), "score": pa.array(s[ok], pa.float64())})

    return run
