"""The pipeline's stages one by one on planted rows, and the registry."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline as C
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rankweave.llm import blocks, packing, similar
from rankweave.llm.fasttok import tokenizer


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    clean = [(i, " ".join(f"word{(i * 31 + j * j * 7) % 997}q{(i + j) % 13}" for j in range(90)), "en", "s", 5) for i in range(12)]
    passage = " ".join(f"passage{i}" for i in range(60))
    item = " ".join(f"bench{i}" for i in range(20))
    own = [" ".join(f"own{k}a{j}" for j in range(120)) for k in range(2)]
    planted = [(20, clean[3][1], "en", "s", 5), (21, f"{own[0]} {passage}", "en", "s", 5), (22, f"{own[1]} {passage} others", "en", "s", 5), (23, f"about {item} here", "en", "s", 5), (24, "123 456", None, "s", 7), (25, None, None, None, None)]
    spark.createDataFrame(clean + planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in C.STAGES[:-1]:
        docs = blocks.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == C.COLUMNS
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = set(range(12))
    assert set(seen["language_id"]) == ids | {20, 21, 22, 23}
    assert set(seen["near_dedup"]) == ids | {21, 22, 23}
    assert seen["substring_dedup"][22] == f"{own[1]} others" and passage in seen["substring_dedup"][21]
    assert set(seen["decontamination"]) == ids | {21, 22}
    assert all(seen["decontamination"][i] == t for i, t, *_ in clean)
    packed = C.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids | {21, 22}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(C.STAGES) == 5


def test_edited_copies_go_by_shingle_similarity(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    edited = lambda n: [f"e{rng.randrange(10**6)}" if i in at else w for at in [set(rng.sample(range(160), n))] for i, w in enumerate(base)]
    texts = [" ".join(edited(n)) for n in [0, *[1, 2, 3, 4] * 60]]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(120)) for _ in range(40)] + ["", None, "few words", "Few  words", "few word"]
    shingles = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    near = [[j for j in range(len(texts)) if x == shingles[j] or 5 * len(x & shingles[j]) >= 4 * len(x | shingles[j]) > 0] for x in shingles]
    group = list(range(len(texts)))
    while (after := [min(group[j] for j in n) for n in near]) != group:
        group = after
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()} == dict(enumerate(group))
    assert {r["doc_id"] for r in C.near_dedup(spark, docs, "").collect()} == set(group)


def test_near_duplicates_of_awkward_rows(rows, docs, none):
    got = [(str(r["doc_id"]), r["component_id"]) for r in similar.similar_groups(docs).collect()]
    assert len(got) == len(rows) and {c for d, c in got if d in ("1", "7", "-5")} == {-5} and {c for d, c in got if d == "9"} == {8}
    assert similar.similar_groups(none).count() == 0


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_long_documents_lose_benchmark_windows(spark, tmp_path, monkeypatch, block):
    items = [" ".join(f"bench{k}x{i}" for i in range(14)) for k in range(2)]
    half = items[1].split()
    filler = lambda n: " ".join(f"é{n}y{i}" for i in range(400))
    nested = f"{filler(1)}, {' '.join(half[:6])} {items[0]}! {' '.join(half[6:])} {filler(2)}"  # the second shows once the first is cut
    texts = [filler(0), f"{filler(3)} {items[0]}.", nested, f"{items[1]} word", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    whole = C.decontam.decontaminate
    monkeypatch.setattr(C.decontam, "decontaminate", lambda *a, **b: whole(*a, block_bytes=block, **b))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in C.decontamination(spark, docs, str(tmp_path)).collect()}
    want = {1: f"{filler(3)} ", 2: f"{filler(1)}, {filler(2)}"}
    assert got == {0: (texts[0], 1), 4: (None, 1), **{i: (t, len(t)) for i, t in want.items()}}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plainly(rows, items):
    """The documents (doc_id, text) that the first four stages leave, by enumeration."""
    docs = [r[:2] for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, t in docs for w in [re.findall("[^\x20\x09-\x0d]+", lower(t))]]
    group = list(range(len(docs)))
    while (after := [min(group[j] for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)) for x in sets]) != group:
        group = after
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    docs = [docs[i] for i in first.values()]
    starts = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        for j in range(len(w) - 49):
            if i is not None:
                starts[tuple(w[j : j + 50])] = min(i, starts.get(tuple(w[j : j + 50]), i))
    cut = []
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        gone = {p for j in range(len(w) - 49) if i is not None and starts[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
        if len(gone) < len(w):
            cut.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    windows = [w if len(w) < 13 else w[j : j + 13] for t in items for w in [WORD.findall(lower(t))] for j in range(max(1, len(w) - 12)) if w]
    clean = []
    for i, t in cut:
        while True:
            found = list(WORD.finditer(lower(t)))
            w = [m.group() for m in found]
            hit = {p for x in windows for j in range(len(w) - len(x) + 1) if w[j : j + len(x)] == x for p in range(j, j + len(x))}
            if 20 * len(hit) >= len(w) and hit:
                break
            if not hit:
                clean.append((i, t))
                break
            ends = [m.start() for m in found[1:]] + [len(t)]
            gone = {p for h in hit for p in range(found[h].start(), ends[h])}
            t = "".join(c for p, c in enumerate(t) if p not in gone)
    return clean


def written(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_the_whole_pipeline_against_enumeration(spark, tmp_path):
    rng = random.Random(21)
    free = lambda n, k: [f"w{rng.randrange(10**k)}" for _ in range(n)]
    items = [" ".join(free(15, 6)), " ".join(free(30, 6)), "two words"]
    passage, base = free(70, 6), free(120, 6)
    texts = [" ".join(free(rng.randint(1, 200), 5)) for _ in range(30)]
    texts += [" ".join(base[:k] + free(3, 6) + base[k + rng.randint(0, 3) :]) for k in (0, 20, 50, 90, 118)] + [" ".join(base), " ".join(base).upper()]
    texts += [" ".join(free(40, 6) + passage + free(30, 6)) for _ in range(3)] + [" ".join(passage), "  ".join(passage)]
    texts += [" ".join(free(n, 6)) + f" {items[j]}. " + " ".join(free(n, 6)) for n in (5, 400) for j in (0, 1, 2)]
    texts += [None, "", "12 !! 3", "x", "X", "é", " ".join(free(20_000, 7)), " ".join(f"a{i % 40}" for i in range(5000))]
    rows = [(i, t, "en" if i % 4 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, "another text with the number five", "en", "s", 33), (None, texts[7], "en", "s", 5), (None, "no number at all", None, None, None), (None, "no number at all", None, None, None), (-3, texts[31], "en", "s", 5)]
    folder = written(spark, tmp_path, rows, items)
    want, docs = plainly(rows, items), spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = blocks.stored(stage(spark, docs, folder))
        assert docs.columns == C.COLUMNS
    left = docs.collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter(want)
    was = {r[:2]: r[4] for r in rows}
    assert all(r["n_chars"] == was.get((r["doc_id"], r["text"]), len(r["text"])) for r in left)
    assert {r["lang"] for r in left if r["doc_id"] is not None and r["doc_id"] >= 0} == {"en"}  # the only language there is
    t, pieces = tokenizer(packing.tokenizer_file()), Counter()
    for i, text in want:
        ids = [*t.slow.encode(text, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces.update((i, p, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])))
    packed = C.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    room = Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1


def test_an_empty_corpus_and_one_without_labels(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "bare").mkdir()
    assert C.run(spark, written(spark, tmp_path / "none", [], ["an item"])).count() == 0
    rows = [(i, f"text number {i} of a corpus without a label", None, None, None) for i in range(50)] + [(60, "55 66", None, None, None)]
    packed = C.run(spark, written(spark, tmp_path / "bare", rows, ["an item"]))
    assert {r["doc_id"] for r in packed.collect()} == set(range(50))  # nothing is known of a language, so none is rejected


def test_a_hot_group_meets_few_of_its_pairs(spark):
    """Edited copies of one text: the pairs that are compared grow with the copies, not with their square."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    made, shown = [], similar.similar
    similar.similar = lambda pairs, *a: made.append(pairs.count()) or shown(pairs, *a)
    try:
        for n in (100, 400):
            texts = [" ".join(w if j not in at else f"e{rng.randrange(60)}" for j, w in enumerate(base)) for _ in range(n) for at in [set(rng.sample(range(150), rng.randint(1, 9)))]]
            docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            similar.similar_groups(docs).count()
    finally:
        similar.similar = shown
    assert made[0] + made[1] < 30 * 100 and made[2] + made[3] < 30 * 400


def broadcast_mb(spark, first: int) -> float:
    """MB of the largest table that went through the driver for a join, of executions from number `first` on."""
    store, units, most = spark._jsparkSession.sharedState().statusStore(), {"B": 1e-6, "KiB": 1.024e-3, "MiB": 1.048576, "GiB": 1073.741824}, 0.0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = store.executionsList()
    for e in (i for i in (listed.apply(k).executionId() for k in range(listed.size())) if i >= first):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (n for n in (nodes.apply(k) for k in range(nodes.size())) if n.name() == "BroadcastExchange"):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if m.name() == "data size" and values.contains(m.accumulatorId()):
                    size, unit = re.search(r"([\d.,]+) (\w+)", values.apply(m.accumulatorId())).groups()
                    most = max(most, float(size.replace(",", "")) * units[unit])
    return most


def test_near_dedup_sends_no_table_that_grows_through_the_driver(spark):
    """Every text has two edited copies; at Spark's own threshold (10 MB) links, entries and texts would be broadcast."""
    rng, n = random.Random(8), 2000
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(i + n * k, " ".join([*words[:-k], *(f"e{rng.randrange(10**6)}" for _ in range(k))] if k else words), "en", "s", 1) for k in range(3)]
    docs = blocks.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = max((listed.apply(k).executionId() for k in range(listed.size())), default=-1) + 1
    before = spark.conf.get(blocks.BROADCAST, None)
    assert {r["doc_id"] for r in C.near_dedup(spark, docs, "").collect()} == set(range(n))
    assert broadcast_mb(spark, first) < 16 and spark.conf.get(blocks.BROADCAST, None) == before


@pytest.mark.parametrize("n", [1, 1 << 15, 1 << 16, 1 << 30])
def test_segments_follow_the_number_of_texts(n):
    got, width = similar.layout(n, (4, 5), 1e-3)
    assert 1 << width >= 2 * n and width >= 16
    q = similar.differing((4, 5))
    near = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
    assert (1 - near) ** got <= 1e-3 < (1 - near) ** (got - 1)
