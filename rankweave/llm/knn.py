"""Exact top-k by inner product: a KD-tree per shard, traversed best-first.

A shard's vectors are split at the median of the widest dimension down to leaves, and every node keeps the tight box
around its vectors.  The greatest inner product that a box allows bounds what a node can hold: best-first traversal
visits a query's leaves from the greatest bound down and stops at the first that cannot reach the query's kth score.
The kth score goes on twice: from shard to shard within a run of shards that one task visits, and from a block's first
run, which a round of its own visits, to all others.  A shard whose box reaches no kth score gets no tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

HITS = "query_id long, print long, vec_id long, copies long, score long"
LIST = ["query_id", "rank", "vec_id", "score"]
NONE = -(1 << 62)
#: Different lengths of vectors up to which the table of their counts goes to every task.
LENGTHS = 10_000


class Tree:
    """Leaves of at most `leaf` vectors, and the boxes of leaves and of the subtrees `top` levels down."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, leaf: int = 256):
        self.ids, self.vectors, self.copies = ids, vectors, copies
        self.leaves: list[np.ndarray] = []
        self.subtree: list[int] = []
        roots = 0
        stack = [(np.arange(len(ids)), 0, 0)]
        while stack:
            rows, depth, root = stack.pop()
            if depth == 3:
                roots, root = roots + 1, roots
            if len(rows) <= leaf or not vectors.shape[1]:
                self.leaves.append(rows)
                self.subtree.append(root if depth >= 3 else -1)
                continue
            part = vectors[rows]
            dim = int((part.max(0) - part.min(0)).argmax())
            half = len(rows) // 2
            order = np.argpartition(part[:, dim], half)  # the median
            stack += [(rows[order[half:]], depth + 1, root), (rows[order[:half]], depth + 1, root)]
        for i, r in enumerate(self.subtree):  # leaves above that level are subtrees of their own
            if r < 0:
                self.subtree[i], roots = roots, roots + 1
        self.low = np.array([vectors[r].min(0) for r in self.leaves])
        self.high = np.array([vectors[r].max(0) for r in self.leaves])
        of = np.array(self.subtree)
        self.members = [np.flatnonzero(of == s) for s in range(roots)]
        self.top_low = np.array([self.low[m].min(0) for m in self.members])
        self.top_high = np.array([self.high[m].max(0) for m in self.members])


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product of each query with a point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Best:
    """The k best (greatest score, then smallest id) of each query so far; scores below `floor` are of no use."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.floor = np.full(len(queries), NONE) if floor is None else floor
        self.score = np.full((len(queries), k), NONE, np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.copies = np.zeros((len(queries), k), np.int64)

    @property
    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def _take(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray) -> None:
        s = (self.queries[q] @ vectors.T).astype(np.int64)
        row, col = np.nonzero(self.query_ids[q][:, None] == ids[None, :])
        own = (self.queries[q[row]] == vectors[col]).all(1)
        row, col = row[own], col[own]
        lone = copies[col] == 1
        s[row[lone], col[lone]] = NONE  # not the query itself
        own = set(zip(row[~lone].tolist(), col[~lone].tolist(), strict=True))  # but its copies
        kth = self.kth[q]
        if len(ids) > self.k:  # all that can be among the k best, ties included
            kth = np.maximum(np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k], kth)
        row, col = np.nonzero((s >= kth[:, None]) & (s > NONE))
        times = copies[col].copy()
        if own:
            times -= np.fromiter(((r, c) in own for r, c in zip(row.tolist(), col.tolist(), strict=True)), bool, len(row))
        who = np.r_[np.repeat(np.arange(len(q)), self.k), row]
        score, found, times = np.r_[self.score[q].ravel(), s[row, col]], np.r_[self.found[q].ravel(), ids[col]], np.r_[self.copies[q].ravel(), times]
        order = np.lexsort((found, -score, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        at = q[who[keep]], place[keep]
        self.score[at], self.found[at], self.copies[at] = score[order][keep], found[order][keep], times[order][keep]

    def visit(self, tree: Tree) -> None:
        """Each query's leaves by falling bound, the same step of all queries at once."""
        if not len(tree.ids) or not len(self.queries):
            return
        top = bounds(self.queries, tree.top_low, tree.top_high)
        bound = np.full((len(self.queries), len(tree.leaves)), -np.inf)
        for s, leaves in enumerate(tree.members):
            near = np.flatnonzero(top[:, s] >= self.kth)
            if len(near):
                bound[np.ix_(near, leaves)] = bounds(self.queries[near], tree.low[leaves], tree.high[leaves])
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(self.queries))
        for step in range(len(tree.leaves)):
            leaf = order[live, step]
            b = bound[live, leaf]
            open_ = (b > -np.inf) & (b >= self.kth[live])  # a tie may still bring a smaller id
            live, leaf = live[open_], leaf[open_]
            if not len(live):
                break
            by = np.argsort(leaf, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                rows = tree.leaves[leaf[part[0]]]
                self._take(live[part], tree.ids[rows], tree.vectors[rows], tree.copies[rows])

    def reaches(self, vectors: np.ndarray) -> bool:
        """Whether the box around vectors can hold what any query still looks for."""
        return bool((bounds(self.queries, vectors.min(0, keepdims=True), vectors.max(0, keepdims=True))[:, 0] >= self.kth).any())

    def result(self, prints: np.ndarray) -> pa.Table:
        row, col = np.nonzero(self.score > NONE)
        columns = (self.query_ids[row], prints[row], self.found[row, col], self.copies[row, col], self.score[row, col])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "print", "vec_id", "copies", "score"), columns, strict=True)})


def finite(column: str):
    """That an array isn't null and has no null, NaN or infinity.  To be asked before F.floor, which makes longs of these."""
    return F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def _matrix(t: pa.Table) -> np.ndarray:
    v = t["v"].combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(t), len(flat) // len(t))


def _cell(k: int):
    def run(key: tuple[pa.Scalar, ...], q: pa.Table, t: pa.Table) -> pa.Table:
        if not len(q) or not len(t):
            return pa.table({f: pa.array([], pa.int64()) for f in ("query_id", "print", "vec_id", "copies", "score")})
        best = Best(q["vec_id"].to_numpy(), _matrix(q), k, q["kth"].to_numpy())
        ids, vectors, copies, shard = t["vec_id"].to_numpy(), _matrix(t), t["copies"].to_numpy(), t["shard"].to_numpy()
        for s in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == s)
            if best.reaches(vectors[rows]):
                best.visit(Tree(ids[rows], vectors[rows], copies[rows]))
        return best.result(q["print"].to_numpy())

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = 8192, block_rows: int = 4096, run_shards: int = 8) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k greatest inner products with all other rows.

    vectors has vec_id and v (an array of doubles holding integers, inner products below 2**53); is_query says which
    rows are queries.  Ties go to the smaller vec_id.  Rows with a null vec_id, a null v, or null or non-finite
    components take no part.  Every row but the query's own is a candidate, whatever its vec_id, if its vector has the
    query's length; a row that occurs twice is two candidates, and as a query gives its list twice.  A query without
    candidates has no rows; an empty table gives an empty result.

    Queries go against runs of shards in blocks: a cell is one block and one run, and a last step keeps each query's
    best.  Vectors of each length have blocks and shards of their own.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & finite("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("n", F.size("v"))
    upto = lambda c, per: F.greatest(F.lit(1), F.ceil(c / per)).cast("long")
    sizes = rows.groupBy("n").agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries"))
    sizes = sizes.where("queries > 0").select("n", upto(F.col("rows"), shard_rows).alias("shards"), upto(F.col("queries"), block_rows).alias("blocks"))
    sizes = B.stored(sizes.withColumn("runs", upto(F.col("shards"), run_shards)))
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= LENGTHS else sizes, "n")
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    rows = rows.withColumns({"shard": place("shards", 1), "block": place("blocks", 2)}).withColumn("run", F.floor(F.col("shard") / run_shards))
    queries = rows.where(is_query).withColumnRenamed("copies", "times").withColumn("print", F.xxhash64("v"))
    home, last = F.pmod(F.col("block"), F.col("runs")), lambda c: F.col(c) - 1
    zero, key = F.lit(0).cast("long"), ["n", "block", "run"]
    other = lambda c, end: F.explode(F.sequence(zero, last(end))).alias(c)

    def cogroup(asking: DataFrame, held: DataFrame) -> DataFrame:
        asking = asking.select(*(F.col(c).alias(c) for c in asking.columns))  # both sides come from rows
        return asking.groupBy(key).cogroup(held.groupBy(key)).applyInArrow(_cell(k), HITS)

    candidate, asked = ["n", "vec_id", "v", "copies", "shard"], ["n", "block", "vec_id", "print", "v"]
    # a block's first run
    mine = rows.where("run < blocks").select(*candidate, "run", F.explode(F.sequence(F.col("run"), last("blocks"), F.col("runs"))).alias("block"))
    first = B.stored(cogroup(queries.select(*asked, home.alias("run"), F.lit(NONE).alias("kth")), mine))
    kth = first.groupBy("query_id", "print").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    if sizes.where("runs > 1").isEmpty():
        return _lists(first, queries, k)
    # the others
    rest = rows.where("runs > 1").select(*candidate, "run", "runs", other("block", "blocks")).where(home != F.col("run"))
    known = queries.where("runs > 1").join(kth.withColumnsRenamed({"query_id": "vec_id"}), ["vec_id", "print"], "left")
    known = known.select(*asked, "runs", F.coalesce("kth", F.lit(NONE)).alias("kth"), other("run", "runs")).where(home != F.col("run"))
    return _lists(first.union(cogroup(known, rest)), queries, k)


def _lists(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query of hits (columns of HITS), a candidate's copies each with a rank of its own."""
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    best = best.withColumn("before", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, "before").where(F.col("before") < k)
    ranks = F.explode(F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("copies"), F.lit(k)).cast("int")))
    best = best.select("query_id", "print", ranks.alias("rank"), "vec_id", "score")
    twice = queries.where("times > 1").select(F.col("vec_id").alias("query_id"), "print", "times")
    again = best.join(twice, ["query_id", "print"]).select(*LIST, F.explode(F.sequence(F.lit(2).cast("long"), "times")))
    return best.select(LIST).union(again.select(LIST))


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 rows with the greatest inner products with each row whose vec_id is divisible by 20; see top_k()."""
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = e.where(finite("embedding")).select("vec_id", F.transform("embedding", lambda x: whole(x.cast("double") * 64)).alias("v"))
    return top_k(v, F.col("vec_id") % 20 == 0)
