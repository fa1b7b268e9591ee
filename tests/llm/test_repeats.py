"""Exact repeats across documents against enumeration, and the suffix sort against Python's."""

import random

import numpy as np
import pytest

from rankweave.llm import repeats
from rankweave.llm.suffixes import Suffixes


def cover(items, length):
    """Symbols covered by windows that a smaller id has too; a null id takes no part."""
    first = {}
    for i, s in items:
        for j in range(len(s) - length + 1):
            if i is not None:
                first[tuple(s[j : j + length])] = min(i, first.get(tuple(s[j : j + length]), i))
    for i, s in items:
        gone = [False] * len(s)
        for j in range(len(s) - length + 1):
            if i is not None and first[tuple(s[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        yield i, s, gone


def check_words(spark, rows, window, k, df):
    got = sorted(map(tuple, repeats.substring_dedup(df, window, k, block_bytes=2000).collect()), key=str)
    want = [(i, len(s), sum(g), " ".join(w.decode() for w, x in zip(s, g) if not x)) for i, s, g in cover([(r[0], (r[1] or "").encode().split()) for r in rows], window)]
    assert got == sorted(want, key=str)
    return want


def check_bytes(spark, rows, length, k, df):
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.suffix_array_dedup(df, length, k, block_bytes=2000).collect()), key=str)
    want = []
    for i, s, g in cover([(r[0], (r[1] or "").encode()) for r in rows], length):
        want.append((i, len(s), sum(g), sum(x and not (j and g[j - 1]) for j, x in enumerate(g)), bytes(b for b, x in zip(s, g) if not x)))
    assert got == sorted(want, key=str)
    return want


def test_words_with_awkward_rows(spark, rows, docs):
    want = check_words(spark, rows, 50, 16, docs)
    assert sum(w[2] for w in want) > 6000


def test_bytes_with_awkward_rows(spark, rows, docs):
    assert sum(w[2] for w in check_bytes(spark, rows, 50, 20, docs)) > 6000


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_with_few_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 2 if i % 7 == 0 else i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_words(spark, rows, 9, 4, df)
    check_bytes(spark, rows, 14, 5, df)


def test_empty_tables_and_kept_columns(spark, docs, none):
    assert repeats.substring_dedup(none).count() == 0 and repeats.suffix_array_dedup(none).count() == 0
    out = repeats.substring_dedup(docs, keep=["text", "lang", "doc_id", "g"])
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept", "text", "lang", "g"]
    assert {(r["doc_id"], r["text"], r["lang"]) for r in out.collect()} == {(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()}


def test_suffix_order_and_classes():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    s = Suffixes(data, np.arange(350), 50)
    raw = data.tobytes()
    want = sorted(range(350), key=lambda i: raw[i : i + 50])
    assert s.order().tolist() == want
    classes = s.classes()
    assert all((classes[a] == classes[b]) == (raw[a : a + 50] == raw[b : b + 50]) for a in range(0, 350, 3) for b in range(0, 350, 5))


@pytest.mark.parametrize("window", [50, 300, 400])
def test_long_windows(spark, window):
    rng = random.Random(window)
    shared = [f"s{rng.randrange(500)}" for _ in range(700)]
    rows = [(1, " ".join(shared)), (2, "x " + " ".join(shared) + " y"), (3, " ".join(shared[:350] + ["cut"] + shared[350:])), (4, " ".join(shared[100:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = check_words(spark, rows, window, 16, df)
    assert {i: n for i, _, n, _ in want}[2] == 700
    check_bytes(spark, rows, window, 20, df)


def test_short_windows_and_windows_out_of_range(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a", "c a b", "b b", "", "a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 2, 7):
        check_words(spark, rows, window, 16, df)
        check_bytes(spark, rows, window, 20, df)
    for bad in (0, repeats.LONGEST + 1):
        with pytest.raises(ValueError, match="symbols"):
            repeats.substring_dedup(df, bad)


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_repeats_dont_hang_on_the_rolling_hash(spark, seed, monkeypatch):
    """Different strings whose rolling hashes are equal are told apart: in a block by their bytes, between blocks by a digest."""
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def emitted(step):
        return lambda *a: _weakly(step, *a)

    def _weakly(step, *a):
        from rankweave.llm import blocks

        whole = blocks.Rolling.slices
        blocks.Rolling.slices = lambda self, s, e: whole(self, s, e) & np.uint64(0x7 << 61)  # eight values for all
        try:
            return step(*a)
        finally:
            blocks.Rolling.slices = whole

    steps, final = repeats._steps, repeats.removed
    monkeypatch.setattr(repeats, "_steps", lambda how: [(emitted(e), a) for e, a in steps(how)])
    monkeypatch.setattr(repeats, "removed", emitted(final))
    check_bytes(spark, rows, 14, 5, df)


def test_suffixes_of_several_lengths():
    rng = random.Random(8)
    data = np.frombuffer(bytes(rng.choice(b"\0ab") for _ in range(300)), np.uint8)
    starts, lengths = np.array([rng.randrange(250) for _ in range(400)]), np.array([rng.randrange(1, 40) for _ in range(400)])
    raw = [data.tobytes()[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
    s = Suffixes(data, starts, lengths)
    assert [raw[i] for i in s.order()] == sorted(raw)
    classes = s.classes()
    assert all((classes[a] == classes[b]) == (raw[a] == raw[b]) for a in range(400) for b in range(0, 400, 7))
