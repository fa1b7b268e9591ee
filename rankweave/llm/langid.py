"""Language identification in two steps: the family first, then the language within it.

Both steps vote with one-versus-one linear support vector machines over the frequencies of byte trigrams, lower-cased
in A-Z, in which everything in ASCII that isn't a letter counts as a space.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BITS = 13
SIZE = 1 << BITS
LETTER = B.byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
FOLD = np.where(LETTER | (np.arange(256) >= 0x80), np.arange(256), 0x20).astype(np.uint8)
FOLD[0x41:0x5B] += 32
#: Language codes by family; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "ur", "mr", "ne"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram frequencies of each text, a row each, and whether it has a letter."""
    data, off = B.buffer(column)
    n = len(off) - 1
    padded = np.insert(FOLD[data], off, 0x20).astype(np.uint32)  # a space around every text
    begin = off + np.arange(n + 1)
    code = (padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(begin))[: len(code)]  # a trigram belongs to the text where it begins
    last = np.minimum(begin[1:] - 1, len(code))  # but not one that reaches into the next text
    code = code.astype(np.int64) + row * SIZE
    whole = np.ones(len(code), bool)
    whole[last[last < len(code)]] = False
    counts = np.bincount(code[whole], minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    letters = np.r_[0, np.cumsum(LETTER[data])]
    plain = letters[off[1:]] > letters[off[:-1]]
    high = np.r_[0, np.cumsum(data >= 0x80)]
    for i in np.flatnonzero(~plain & (high[off[1:]] > high[off[:-1]])).tolist():
        plain[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return counts, plain


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    weight = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) / len(y) * 2 * cost  # both classes count alike
    damp = 0.5 / weight
    norm = (x.astype(np.float64) ** 2).sum(1) + damp
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = max(0.0, a[i] - (y[i] * (w @ x[i]) - 1 + damp[i] * a[i]) / norm[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]) / weight[i])
                a[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


@dataclass
class Vote:
    """One-versus-one machines between classes."""

    classes: list[str]
    weights: np.ndarray  # a column for each pair
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray) -> Vote:
        classes = sorted(set(label.tolist()))
        pairs = []
        for a, b in combinations(classes, 2):
            rows = (label == a) | (label == b)
            pairs.append(machine(x[rows], np.where(label[rows] == a, 1.0, -1.0)))
        w = np.array([p[0] for p in pairs]).reshape(len(pairs), x.shape[1]).T
        return cls(classes, w.astype(np.float32), np.array([p[1] for p in pairs]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Shares of the classes: each pair splits a vote by its margin."""
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        votes = np.zeros((len(x), len(self.classes)))
        p = 1 / (1 + np.exp(-3 * np.clip(x @ self.weights + self.bias, -10, 10)))
        for k, (i, j) in enumerate(combinations(range(len(self.classes)), 2)):
            votes[:, i] += p[:, k]
            votes[:, j] += 1 - p[:, k]
        return votes / (len(self.classes) * (len(self.classes) - 1) / 2)


@dataclass
class Model:
    scale: np.ndarray
    families: Vote
    languages: dict[str, Vote]

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray) -> Model:
        scale = 1 / np.sqrt(x.mean(0) + 1e-5)  # frequent trigrams don't drown the others
        scale = (scale / np.sqrt(((x * scale) ** 2).sum(1).mean())).astype(np.float32)
        x = x * scale
        family = np.array([family_of(v) for v in lang.tolist()])
        return cls(scale, Vote.fit(x, family), {f: Vote.fit(x[family == f], lang[family == f]) for f in sorted(set(family.tolist()))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = x * self.scale
        share = self.families(x)
        best = share.argmax(1)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.families.classes):
            rows = np.flatnonzero(best == i)
            if len(rows):
                inner = self.languages[f](x[rows])
                pick = inner.argmax(1)
                lang[rows] = np.array(self.languages[f].classes, object)[pick]
                score[rows] = share[rows, i] * inner[np.arange(len(rows)), pick]
        return lang.tolist(), np.clip(score, 0, 1)


def _sample(labelled: DataFrame, per_language: int, most: int) -> list:
    """About per_language texts of each language, chosen by a hash of the id, and about `most` in all: (lang, trigram
    codes, frequencies).  Of more than `most` languages the most frequent ones are learned."""
    frequent = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, most // len(counts)))
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for whole in batches:
            for b in B.pieces(whole, "text", 1 << 20):
                x, letter = features(b.column("text"))
                rows = [(lang, np.flatnonzero(r).astype("<u2").tobytes(), r[r > 0].astype("<f4").tobytes()) for lang, r, ok in zip(b.column("lang").to_pylist(), x, letter, strict=True) if ok]
                yield pa.record_batch({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("lang", pa.string()), ("code", pa.binary()), ("value", pa.binary())))})

    return labelled.where(F.coalesce(lot < share[F.col("lang")], F.lit(False))).select("text", "lang").mapInArrow(run, "lang string, code binary, value binary").collect()


def train(labelled: DataFrame, per_language: int = 400, most: int = 8000) -> Model | None:
    """A model of labelled texts (doc_id, text, lang).  per_language and most, about, bound the sample that is fitted on
    (400 texts a language, 8000 in all); the rows that reach the driver are trigram frequencies.  None if no text with a
    letter has a language."""
    B.small_batches(labelled.sparkSession)
    rows = _sample(labelled.where("lang is not null and text is not null and doc_id is not null"), per_language, most)
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["code"], r["value"]))
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["code"], "<u2")] = np.frombuffer(r["value"], "<f4")
    return Model.fit(x, np.array([r["lang"] for r in rows]))


def identify(docs: DataFrame, model: Model | None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, lang_pred and score (0 to 1) of each row, from its whole text, and the columns in keep.  A text that is
    null or has no letter, and any text if there is no model, is 'und' with score 0; a null doc_id stays null."""
    B.small_batches(docs.sparkSession)
    extra, schema = B.widened_schema(docs, "doc_id long, lang_pred string, score double", keep)

    def run(batches):
        for whole in batches:
            for b in B.pieces(whole, "text", 1 << 20):
                for s in range(0, b.num_rows, 256):
                    part = b.slice(s, 256)
                    x, letter = features(part.column("text"))
                    lang, score = model.predict(x) if model else ([UNKNOWN] * len(x), np.zeros(len(x)))
                    lang = [v if ok else UNKNOWN for v, ok in zip(lang, letter.tolist(), strict=True)]
                    yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.where(letter, score, 0.0), pa.float64())} | {c: part.column(c) for c in extra})
        B.release()

    return docs.select("doc_id", "text", *(c for c in extra if c != "text")).mapInArrow(run, schema)


def lettered(text: str):
    """That a text has a letter; null has none."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id="doc_id"):
    """Rows that a model never learns from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """identify() of documents, by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs.where(~held_out()).select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
