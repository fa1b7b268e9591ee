"""Near-duplicates by shingle similarity: SimHash proposes by multi-index hashing, the exact Jaccard similarity decides.

1. Support: a shingle that only one text has counts for no similarity.  One exchange of packed keys tells every block
   which of its shingles another text has too; a text of which too few do is near to none and leaves the search.
2. Fingerprints: of the texts left, over the shingles that others share, in segments of a width that follows their
   number, so that a segment's table stays thin at any size.  The number of segments follows from the chance (`miss`)
   of losing a pair of the least similarity allowed: each text looks up the ball of radius 1 around each segment.
3. Representatives: of the entries that a text finds by its first segments it meets two texts, the nearest and the one
   with the largest support.  This links most of a group without its pairs.
4. The rest: by all segments, a text meets those of larger components than its own, if masks of their shingles allow it.

Every pair that shares a ball is thus compared, or its two texts are linked by others.  Pairs pass the bounds that
sizes and supports give, the distance of 64 bits, masks of the shingles, the whole distance, and the exact similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .blocks import U
from .components import components
from .decontam import LOWER
from .repeats import SPACE

SUPPORT = "doc_id long, __hash__ long, node long, n long, s long, body binary"
PRINTS = "node long, n long, s long, head long, print binary, mask array<long>, segments array<long>, body binary"
BRIEF = ["node", "n", "s", "head"]
#: Longs of a mask, in which every supported shingle sets a bit.
MASK = 16
#: Standard deviations that a distance may lie above its mean at the least similarity allowed.
SLACK = 4.5


class Shingles:
    """Distinct shingles of a block's rows: `key` in order, the `row` of each, and a hash of each row's set.

    Rows with equal sets share theirs: only the first of them (`first`) has entries.
    """

    def __init__(self, column, size: int):
        data, off = B.buffer(column)
        data = LOWER[data]
        start, end = B.spans(~SPACE[data], off)
        bounds = np.searchsorted(start, off)
        words = np.diff(bounds)
        count = np.where(words >= size, words - size + 1, words > 0)
        row = np.repeat(np.arange(len(words)), count)
        at = bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        key = B.Rolling(B.word_symbols(data, start, end)).slices(at, at + np.minimum(words[row], size))
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        one = np.ones(len(key), bool)
        one[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[one], row[one]
        self.n = np.bincount(row, minlength=len(words))
        self.node = np.zeros(len(words), U)
        np.add.at(self.node, row, B.mixed(key * U(B.BASES[1])))
        self.node = B.mixed(self.node ^ self.n.astype(U))
        self.first = np.zeros(len(words), bool)
        self.first[np.unique(self.node, return_index=True)[1]] = True
        kept = self.first[row]
        self.key, self.row = key[kept], row[kept]
        new = np.ones(len(self.key), bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.start = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and 1 for those that several rows have."""
        return self.key[self.start], (np.diff(np.r_[self.start, len(self.key)]) > 1).astype(np.uint8)


def support(docs: DataFrame, size: int, least: tuple[int, int], block_bytes: int) -> DataFrame:
    """Columns of SUPPORT for each row of docs (doc_id, text, __hash__): its set's hash, size and support, and the
    supported shingles if they are many enough, once a block and set.

    Keys are cut to 48 bits on the way, so a support may be too large, never too small.
    """
    n = B.spread(docs)

    def emit(g, t, _, buckets):
        key, flag = Shingles(t["text"], size).sent()
        return B.requests(g, buckets, key, B.flagged(key, flag), b"")

    def final(g, t, replies):
        x = Shingles(t["text"], size)
        shared = B.received(replies)[1][x.group]
        s = np.bincount(x.row[shared], minlength=len(t))
        body: list[bytes | None] = [None] * len(t)
        order = np.argsort(x.row[shared], kind="stable")
        keys, cut = x.key[shared][order], np.r_[0, np.cumsum(s)]
        for i in np.flatnonzero(x.first & (x.n > 0) & (least[1] * s >= least[0] * x.n)).tolist():
            body[i] = keys[cut[i] : cut[i + 1]].tobytes()
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "__hash__": t["__hash__"], "node": pa.array(x.node.view(np.int64), pa.int64()), "n": pa.array(x.n, pa.int64()), "s": pa.array(s, pa.int64()), "body": pa.array(body, pa.binary())})

    steps = [(emit, B.answered(("u4", "u2"), B.several))]
    return B.converse(B.grouped(docs, block_bytes, n, ["__hash__"]), n, 2 * n, steps, final, T._parse_datatype_string(SUPPORT))


def differing(least: tuple[int, int]) -> float:
    """The share of bits in which fingerprints differ on average, at the least similarity and equal sizes."""
    s = least[0] / least[1]
    return math.acos(2 * s / (1 + s)) / math.pi


def layout(nodes: int, least: tuple[int, int], miss: float) -> tuple[int, int]:
    """(segments, their width in bits) for a number of texts: a table has at least twice as many entries as texts."""
    width, q = max(16, math.ceil(math.log2(max(nodes, 2))) + 1), differing(least)
    near = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
    return math.ceil(math.log(miss) / math.log(1 - near)), width


def farthest(bits: int, least: tuple[int, int], n: Column, s: Column) -> Column:
    """The distance of fingerprints of so many bits up to which a pair may be similar enough.

    n is the sum of the two sizes, s the product of the two supports: together they say how many shingles the two have
    to share, and so the angle between them.
    """
    share = F.acos(F.least(F.lit(1.0), least[0] / (least[0] + least[1]) * n / F.sqrt(s))) / math.pi
    return bits * share + SLACK * F.sqrt(bits * share * (1 - share)) + 1


def wide_print(keys: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of 64 * words bits; where as many keys have a bit as lack it, the least key decides."""
    ones = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=U) * U(B.BASES[0])
    for s in range(0, len(keys), 1 << 12):
        part = B.mixed(keys[s : s + (1 << 12), None] ^ salt)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        if not s:
            tie = bits[0].astype(np.int64)
    return np.packbits(2 * ones + tie > len(keys), bitorder="little")


def mask(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MASK, np.uint8)
    bits[(B.mixed(keys) % U(64 * MASK)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def prints(texts: DataFrame, segments: int, width: int) -> DataFrame:
    """Columns of PRINTS of texts (node, n, s, body).  A segment's value has its number in the bits above `width`."""
    words = -(-segments * width // 64)
    power = (1 << np.arange(width, dtype=np.int64))[None, :]

    def run(batches):
        for b in batches:
            keys = [np.frombuffer(x.as_buffer(), U) for x in b.column("body")]
            whole, masks = [wide_print(k, words) for k in keys], [mask(k) for k in keys]
            bits = np.unpackbits(np.array(whole).reshape(len(whole), -1), axis=1, bitorder="little")[:, : segments * width]
            value = (bits.reshape(len(whole), segments, width) * power).sum(2) + (np.arange(segments, dtype=np.int64) << width)
            head = [int.from_bytes(x[:8].tobytes(), "little", signed=True) for x in whole]
            yield pa.record_batch({"node": b.column("node"), "n": b.column("n"), "s": b.column("s"), "head": pa.array(head, pa.int64()), "print": pa.array([x.tobytes() for x in whole], pa.binary()), "mask": pa.array(masks, pa.list_(pa.int64())), "segments": pa.array(list(value), pa.list_(pa.int64())), "body": b.column("body")})

    return texts.select("node", "n", "s", "body").mapInArrow(run, PRINTS)


def _may_link(a: str, b: str, least: tuple[int, int]) -> Column:
    """What n, s and head of two sides (columns with these prefixes) allow."""
    c = lambda side, name: F.col(side + name)
    low, high = (f(c(a, "n"), c(b, "n")) for f in (F.least, F.greatest))
    sizes = least[1] * low >= least[0] * high
    supports = (least[0] + least[1]) * F.least(c(a, "s"), c(b, "s")) >= least[0] * (c(a, "n") + c(b, "n"))
    distance = F.bit_count(c(a, "head").bitwiseXOR(c(b, "head")))
    return sizes & supports & (distance <= farthest(64, least, c(a, "n") + c(b, "n"), (c(a, "s") * c(b, "s")).cast("double")))


def _may_share(a: str, b: str, least: tuple[int, int]) -> Column:
    """What n, s and mask of two sides allow: a bit that the other side lacks stands for a shingle that it lacks."""
    c = lambda side, name: F.col(side + name)
    lacks = lambda x, y: sum(F.bit_count(c(x, "mask")[i].bitwiseAND(F.bitwise_not(c(y, "mask")[i]))) for i in range(MASK))
    most = F.least(c(a, "s") - lacks(a, b), c(b, "s") - lacks(b, a))
    return (least[0] + least[1]) * most >= least[0] * (c(a, "n") + c(b, "n"))


def similar(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int], bits: int) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose whole distance and exact similarity allow a link."""
    of = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "s", "print", "body")))
    far = farthest(bits, least, F.col("u_n") + F.col("v_n"), (F.col("u_s") * F.col("v_s")).cast("double"))

    def run(batches):
        for b in batches:
            keep = []
            for nx, ny, most, p, q, x, y in zip(*(b.column(c) for c in ("u_n", "v_n", "far", "u_print", "v_print", "u_body", "v_body")), strict=True):
                near = int(np.bitwise_count(np.frombuffer(p.as_buffer(), np.uint8) ^ np.frombuffer(q.as_buffer(), np.uint8)).sum()) <= most.as_py()
                both = len(np.intersect1d(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), assume_unique=True)) if near else 0
                keep.append(near and least[1] * both >= least[0] * (nx.as_py() + ny.as_py() - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with B.setting(nodes.sparkSession, B.BATCH_ROWS, "16"):  # a long text's set has as many bytes as the text
        return B.stored(pairs.join(of("u"), "u").join(of("v"), "v").withColumn("far", far).mapInArrow(run, "u long, v long"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _asked(nodes: DataFrame, width: int, segments: Column, columns: list[str]) -> DataFrame:
    """Keys of the balls around the nodes' segments."""
    ball = F.transform(F.array(F.lit(0), *(F.lit(1 << i) for i in range(width))), lambda m: F.col("own").bitwiseXOR(m.cast("long")))
    return nodes.select(F.explode(segments).alias("own"), *columns).select(F.explode(ball).alias("key"), *columns)


def _represented(nodes: DataFrame, width: int, least: tuple[int, int], segments: int) -> DataFrame:
    """Pairs of each node with two of the representatives that its first segments find: the nearest, and that with the
    largest support."""
    some = F.slice("segments", 1, segments)
    entries = nodes.select(F.explode(some).alias("key"), *BRIEF)
    clean = F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("lacking"), *BRIEF)
    tables = entries.groupBy("key").agg(F.min(clean).alias("r")).select("key", *(F.col(f"r.{c}").alias(f"r_{c}") for c in ("lacking", *BRIEF)))
    near = (F.col("node") != F.col("r_node")) & _may_link("", "r_", least)
    found = _asked(nodes, width, some, BRIEF).alias("p").join(tables.alias("t"), (F.col("p.key") == F.col("t.key")) & near)
    distance = F.bit_count(F.col("head").bitwiseXOR(F.col("r_head")))
    best = found.groupBy(F.col("node").alias("a")).agg(F.min(F.struct(distance, "r_node")).alias("x"), F.min(F.struct("r_lacking", "r_node")).alias("y"))
    return _pairs(best.select("a", F.explode(F.array("x.r_node", "y.r_node")).alias("b")))


def _apart(rooted: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """Pairs of nodes (BRIEF, mask, segments, rank) that share a ball, may be linked, and have different ranks.

    A rank is a component's size and root.  Of a pair the node with the lower rank asks, so an entry that holds one
    component only is left alone by its members.
    """
    entries = rooted.select(F.explode("segments").alias("key"), *BRIEF, "rank")
    one = F.struct("rank", *BRIEF)
    bounds = [F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("s").alias("most"), F.max("rank").alias("highest")]
    tables = entries.groupBy("key").agg(F.min(one).alias("x"), F.max(one).alias("y"), *bounds)
    tables = tables.select("key", "size", "low", "high", "most", "highest", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "xy" for c in BRIEF))
    two = _may_link("", "x_", least) | _may_link("", "y_", least)
    sizes = (least[1] * F.col("high") >= least[0] * F.col("n")) & (least[1] * F.col("n") >= least[0] * F.col("low"))
    supports = (least[0] + least[1]) * F.least("s", "most") >= least[0] * (F.col("n") + F.greatest("low", least[0] * F.col("n") / least[1]))
    some = F.when(F.col("size") > 2, sizes & supports).otherwise(two)
    asked = _asked(rooted, width, F.col("segments"), [*BRIEF, "rank"]).alias("p")
    open_ = asked.join(tables.alias("t"), (F.col("p.key") == F.col("t.key")) & (F.col("rank") < F.col("highest")) & some)
    open_ = B.stored(open_.select(F.col("p.key").alias("key"), "node", "rank"))
    full = rooted.select(*BRIEF, "mask")
    open_, held = (x.join(full, "node") for x in (open_, entries.select("key", "node", "rank").join(open_.select("key").distinct(), "key", "left_semi")))
    open_ = open_.select(*(F.col(c).alias(f"p_{c}") for c in ("key", "rank", *BRIEF, "mask")))
    met = open_.join(held, (F.col("p_key") == F.col("key")) & (F.col("p_rank") < F.col("rank")) & _may_link("p_", "", least) & _may_share("p_", "", least))
    return _pairs(met.select(F.col("p_node").alias("a"), F.col("node").alias("b")))


def roots(nodes: DataFrame, segments: int, width: int, least: tuple[int, int], first: int = 4) -> DataFrame:
    """node and root of the nodes (columns of PRINTS) that are linked to another, but the roots themselves."""
    bits = 64 * -(-segments * width // 64)
    linked = similar(_represented(nodes, width, least, first), nodes, least, bits)
    found = components(linked)
    rooted = nodes.select(*BRIEF, "mask", "segments").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    weight = rooted.groupBy("root").agg(F.count("*").alias("weight"))
    rooted = B.stored(rooted.join(weight, "root").select(*BRIEF, "mask", "segments", F.struct("weight", "root").alias("rank")))
    rest = similar(_apart(rooted, width, least), nodes, least, bits)
    return found if rest.isEmpty() else components(rest.union(linked))


def similar_groups(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), miss: float = 1e-3, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, text_hash, group and component_id of each row: rows that similarities of `least` or more reach from each
    other have the same group (any number) and component_id (their least doc_id).

    docs needs doc_id and text; other columns are ignored.  A similarity is the Jaccard index of the sets of word
    shingles; words are lower-cased in A-Z only.  A text shorter than a shingle is one shingle; texts without words,
    and null, are one group.  A row without doc_id belongs to its group, which it never names; the component_id of a
    group of such rows only is null.  Repeated rows each give a row.  An empty table gives an empty result.
    text_hash is xxhash64 of the text.  A pair of similarity `least` that no third text links is missed with a chance
    of `miss` at most, by the model of independent bits; one of more similarity with a smaller one.
    """
    spark = docs.sparkSession
    B.small_batches(spark)
    rows = B.stored(support(docs.select("doc_id", "text", F.xxhash64("text").alias("__hash__")), shingle, least, block_bytes))
    texts = rows.where("body is not null")
    count = texts.select("node").distinct().count()
    if not count:
        return _named(rows.withColumn("root", F.col("node")))
    segments, width = layout(count, least, miss)
    with B.setting(spark, B.BATCH_ROWS, "64"):
        nodes = B.stored(prints(texts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "s", "body"))), segments, width))
    with B.small_broadcasts(spark):
        linked = roots(nodes, segments, width, least)
    found = rows.select("doc_id", "__hash__", "node").join(linked, "node", "left")
    return _named(found.withColumn("root", F.coalesce("root", "node")))


def _named(found: DataFrame) -> DataFrame:
    component = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(component, "root").select("doc_id", F.col("__hash__").alias("text_hash"), F.col("root").alias("group"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row with the least doc_id (null last) of each group of similar_groups(docs); of rows that share it one, and
    of repeated rows one."""
    with B.small_broadcasts(docs.sparkSession):
        groups = B.stored(groups)
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        kept = groups.groupBy("group").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
        kept = groups.join(kept.alias("k"), groups["doc_id"].eqNullSafe(F.col("k.doc_id")) & groups["text_hash"].eqNullSafe(F.col("k.text_hash")), "left_semi")
        kept = B.stored(kept.groupBy(F.col("doc_id").alias("__id__"), F.col("text_hash").alias("__hash__")).agg(F.count("*").alias("__rows__")))
    same = docs["doc_id"].eqNullSafe(F.col("__id__")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__hash__"))
    if kept.where("__rows__ > 1").isEmpty():
        return docs.join(B.shuffled(kept), same, "left_semi")
    out = docs.join(B.shuffled(kept), same)
    again = out.where("__rows__ > 1").dropDuplicates(["__id__", "__hash__"])
    return out.where("__rows__ = 1").union(again).select(*docs.columns)
