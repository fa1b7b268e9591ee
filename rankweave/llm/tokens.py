"""Token counts by a separator scan over flat token files, which hold ids and end-of-document ids and no index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .fasttok import tokenizer
from .files import Roll, opened
from .packing import tokenizer_file

MANIFEST = "file string, ordinal long, doc_id long, size long"


def write_flat(docs: DataFrame, tokenizer_path: str, folder: str, separator: int, width: int) -> DataFrame:
    """Writes every text's ids and a separator to flat files of little-endian unsigned ids of `width` bytes.

    Returns the manifest: a row (file, ordinal, doc_id) for each document, and one with ordinal -1 and the size in
    bytes for each file.  It has no positions.  A null text is an empty one.  A separator's own string inside a text is
    encoded as ordinary text.
    """
    B.small_batches(docs.sparkSession)

    def write(batches):
        roll, ordinal, sizes = Roll(folder, ".tok"), 0, {}
        for whole in batches:
            for batch in B.pieces(whole, "text", 1 << 20):
                data, off = B.buffer(batch.column("text"))
                ids, bounds = tokenizer(tokenizer_path).encode(data, off, special=False)
                flat = np.insert(ids, bounds[1:], separator).astype(f"<u{width}").tobytes()
                name, at = roll.write(flat)
                ordinal = 0 if at == 0 else ordinal
                sizes[name] = at + len(flat)
                n = batch.num_rows
                yield pa.record_batch({"file": pa.array([name] * n), "ordinal": pa.array(range(ordinal, ordinal + n), pa.int64()), "doc_id": batch.column("doc_id").cast(pa.int64()), "size": pa.nulls(n, pa.int64())})
                ordinal += n
        roll.close()
        n = len(sizes)
        if n:
            yield pa.record_batch({"file": pa.array(list(sizes)), "ordinal": pa.array([-1] * n, pa.int64()), "doc_id": pa.nulls(n, pa.int64()), "size": pa.array(list(sizes.values()), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(write, MANIFEST)


def scan_flat(files: DataFrame, folder: str, separator: int, width: int, block: int = 4 << 20) -> DataFrame:
    """Counts the ids between separators of flat files (file, size): file, ordinal, n_tokens.

    Separators are looked for in every block by itself.  A prefix scan over a file's blocks gives each block the number
    of separators before it and the place of the last one, which completes the document that spans its boundary.
    """
    per = block // width
    todo = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))

    def scan(batches):
        system, root = opened(folder)
        for b in batches:
            for name, size, k in zip(*(b.column(c).to_pylist() for c in ("file", "size", "block")), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(min(block, size - k * block), k * block)
                at = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == separator) + k * per
                last = int(at[-1]) if len(at) else None
                yield pa.record_batch({"file": pa.array([name]), "block": pa.array([k], pa.int64()), "n": pa.array([len(at)], pa.int64()), "first": pa.array([int(at[0]) if len(at) else None], pa.int64()), "last": pa.array([last], pa.int64()), "inner": pa.array([np.diff(at) - 1], pa.list_(pa.int64()))})

    found = todo.repartition(B.partitions(files.sparkSession), "file", "block").mapInArrow(scan, "file string, block long, n long, first long, last long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    carry = F.coalesce(F.max("last").over(before), F.lit(-1))
    stitched = found.select("file", "n", "inner", base.alias("base"), (F.col("first") - carry - 1).alias("head")).where("n > 0")
    counts = F.concat(F.array("head"), "inner")
    return stitched.select("file", "base", F.posexplode(counts).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, block: int = 4 << 20) -> DataFrame:
    """Token counts of documents (doc_id, text; other columns are ignored) by way of flat token files.

    Returns doc_id and n_tokens for each row.  Null and empty texts have none; a null doc_id stays null; repeated rows
    each get a row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer(tokenizer_path)
    separator = next(iter(vocabulary.special.values()), vocabulary.size)
    width = 2 if max(separator, vocabulary.size - 1) < 1 << 16 else 4
    folder = B.scratch(spark)
    manifest = B.stored(write_flat(docs, tokenizer_path, folder, separator, width))
    counted = scan_flat(manifest.where("ordinal < 0").select("file", "size"), folder, separator, width, block)
    # the planner takes the counts for as small as the list of files, and they aren't: no broadcast
    return manifest.where("ordinal >= 0").join(counted.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts() of documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
