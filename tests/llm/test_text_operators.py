"""Language ID, decontamination, token counts, packing, SimHash and language-model scores on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankweave.llm import blocks, decontam, langid, lm, packing, simhash, tokens
from rankweave.llm.components import components
from rankweave.llm.fasttok import tokenizer

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- decontamination


def test_decontamination(spark, rows, docs, none):
    words = WORD.findall(lower(rows[0][1]))
    bench = [(1, " ".join(words[5:30])), (2, "The CAT"), (3, "é"), (4, None), (5, "..."), (None, "the cat"), (10, "the cat sat on the mat and looked at the dog over there now"), (2, "a a a")]
    table = spark.createDataFrame(bench, "item_id long, text string").withColumn("score", F.lit(1))
    windows = {}
    for i, t in bench:
        w = WORD.findall(lower(t))
        for j in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    want = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        hit, items = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    items |= found
                    hit[j : j + n] = [1] * n
        want.append((r[0], len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    for size, items in ((1 << 20, table), (60, table), (60, table.withColumn("item_id", F.col("item_id").cast("string")))):
        got = decontam.decontaminate(docs, items, block_bytes=size, keep=["lang", "score"])
        assert sorted(map(str, (tuple(r)[:6] for r in got.collect()))) == sorted(map(str, want))
        assert got.columns[6:] == ["lang", "score"]
    assert decontam.decontaminate(none, table).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(docs, table.limit(0)).collect()} == {0}


# ---- language ID


def test_language_id(spark, docs, none):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "and", "with", "house", "thing"], "de": ["der", "und", "mit", "haus", "ding"], "fr": ["le", "et", "avec", "maison", "chose"], "es": ["el", "y", "con", "casa", "cosa"], "xx": ["qq", "zz", "kk"]}
    data = [(i, " ".join(rng.choices(vocabulary[lang], k=rng.randint(3, 40))), lang) for i, lang in enumerate(sorted(vocabulary) * 60)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    held = {r["doc_id"] for r in table.where(langid.held_out()).collect()}
    assert held == {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 3 == 1}
    model = langid.train(table.where(~langid.held_out()), per_language=30)
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in data if i in held]
    assert sum(right) / len(right) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    odd = langid.identify(docs, model, keep=["lang", "score"]).collect()
    assert len(odd) == docs.count()
    for r in odd:
        if r["doc_id"] in (3, 4, 5, 13):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (1, 6, 10):
            assert r["lang_pred"] in vocabulary
    assert langid.identify(none, model).count() == 0 and langid.train(none) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.family_of("de") == langid.family_of("en") != langid.family_of("fr")


# ---- tokens


def test_ids_equal_the_tokenizers(rows):
    t = tokenizer(packing.tokenizer_file())
    rng = random.Random(2)
    letters = [*"abst'  \n\t.!19é漢ß½'", " ", "　", "́", "\U0001f600", "\x00", "\x1c", "'s", "'re", " 'll", "<|endoftext|>", "\r\n"]
    texts = [r[1] or "" for r in rows] + ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(1500)]
    for special in (True, False):
        reference = t.slow if special else t.literal
        ids, bounds = t.encode(*blocks.buffer(pa.array(texts)), special=special)
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_every_character_is_of_the_tokenizers_class():
    t = tokenizer(packing.tokenizer_file())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}1 {chr(c)}" for c in points[s : s + 50_000]]
        ids, bounds = t.encode(*blocks.buffer(pa.array(texts)), special=False)
        want = t.literal.encode_batch_fast(texts, add_special_tokens=False)
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [e.ids for e in want]


def test_the_number_of_segments_follows_the_fingerprints():
    assert [simhash.fewest_rows(n, 4) for n in (10, 10**6, 10**9, 10**11)] == [3, 3, 2, 2]
    assert simhash.fewest_rows(10, 0) == 1


def test_token_counts(spark, rows, docs, none):
    t = tokenizer(packing.tokenizer_file())
    want = sorted((str(r[0]), len(t.literal.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for block in (1 << 20, 64):
        assert sorted((str(a), b) for a, b in tokens.token_counts(docs, packing.tokenizer_file(), block).collect()) == want
    assert tokens.token_counts(none, packing.tokenizer_file()).count() == 0


# ---- packing


@pytest.mark.parametrize("cap", [packing.Capacity(64), packing.Capacity(64, rule="dot"), packing.Capacity(64, documents=3), packing.Capacity(64, cost=4096, weights=(1, 1, 1)), packing.Capacity(64, documents=2, cost=4200)])
def test_packing_holds_every_piece_once(spark, rows, docs, cap):
    out = packing.pack_documents(docs, packing.tokenizer_file(), cap).collect()
    t = tokenizer(packing.tokenizer_file())
    want = Counter()
    for r in rows:
        ids = [*t.slow.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % cap.tokens or cap.tokens
        cuts = [0, *range(first, len(ids) + 1, cap.tokens)]
        for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[r[0], p, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= cap.tokens and (cap.documents is None or len(s) <= cap.documents) and (cap.cost is None or sum(n * n for _, n in s) <= cap.cost)
    if cap.documents is None and cap.cost is None:
        assert len(sequences) <= -(-sum(n for s in sequences.values() for _, n in s) // cap.tokens) + 1


def test_packing_of_nothing(none):
    assert packing.pack_documents(none, packing.tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        packing.plan({10: 1}, packing.Capacity(9))


# ---- SimHash


def prints(text, n=4):
    w = lower(text).encode().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, rows, docs, none):
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") * 3 for _ in range(200)]
    near = [(100 + i, " ".join(w if rng.random() > 0.004 * (i % 3) else "zz" for w in base)) for i in range(60)]
    table = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(near, "doc_id long, text string").withColumn("fp", F.lit(1)))
    texts = [(r[0], r[1]) for r in rows] + near
    fp = [prints(t) for _, t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        group = [min(group[j] for j in range(len(texts)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(texts))]
    want = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if group[j] == group[i] and texts[j][0] is not None]
        want.append((d, fp[i], min(ids, default=None)))
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("bits", "segments"), [(4, 3), (2, 3), (5, 2)])
def test_links_find_every_close_pair(spark, bits, segments):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, segments).collect()}
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (values[i] ^ values[j]).bit_count() <= bits}


def test_dense_groups_are_linked_without_their_pairs(spark):
    """Copies with up to two changed bits around three centres, two of them a chain apart, and lone fingerprints."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    far = centre ^ sum(1 << p for p in (1, 5, 9, 23, 25, 29, 45, 50, 61))
    chain = [centre ^ sum(1 << p for p in (1, 5, 9, 23, 25, 29, 45, 50, 61)[:n]) for n in (4, 7)]
    around = lambda c, n: {c ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 2))) for _ in range(n)}
    values = around(centre, 300) | around(far, 60) | set(chain) | around(rng.getrandbits(64), 40) | {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    close = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    near = {v: {v} for v in signed}
    for a, b in close:
        near[a].add(b)
        near[b].add(a)
    want = {v: v for v in signed}
    while (after := {v: min(want[x] for x in near[v]) for v in signed}) != want:
        want = after
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    for segments in (2, 3, 4):
        roots = dict(map(tuple, simhash.linked(nodes, 4, segments).collect()))
        assert {v: roots.get(v, v) for v in signed} == want
        few = {tuple(r) for r in simhash.represented(nodes, 4, segments).collect()}
        assert few <= close and len(few) < 8 * len(signed) < len(close) / 4
    # once all are joined, nothing is left to ask
    rooted = nodes.join(spark.createDataFrame(list(want.items()), "fp long, root long"), "fp").withColumn("rank", F.struct(F.lit(1).alias("size"), "root"))
    assert simhash.apart(rooted.select("fp", "rank"), 4, 3).count() == 0
    alone = nodes.select("fp", F.struct(F.lit(1).alias("size"), F.col("fp").alias("root")).alias("rank"))
    assert {tuple(r) for r in simhash.apart(alone, 4, 3).collect()} == close


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 199)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 200: 199}


# ---- language-model scores


@pytest.mark.parametrize("leave_out", [True, False])
def test_cross_entropy_difference(spark, rows, docs, none, leave_out):
    target = spark.createDataFrame([(1,), (2,), (2,), (None,), (999,)], "doc_id long")
    k, s = 6, 10.0
    words = [WORD.findall(lower(r[1])) for r in rows]
    value = {w: int(lm._words(pa.array([w]))[0][0]) for w in {w for x in words for w in x}}
    order = sorted(value, key=lambda w: (-sum(x.count(w) for x in words), np.uint64(value[w]).astype(np.int64)))
    known = set(order[:k])

    def model(keep, but=None):
        pair, word, context = Counter(), Counter(), Counter()
        for i, (r, w) in enumerate(zip(rows, words)):
            if keep(r[0]) and i != but:
                seq = ["<s>", *(x if x in known else "<?>" for x in w)]
                pair.update(zip(seq, seq[1:]))
                word.update(seq[1:])
                context.update(seq[:-1])
        return pair, word, context

    kept = (lambda d: d in (1, 2)), (lambda d: True)
    got = sorted((str(r["doc_id"]), r["n_words"], r["loss_target"], r["loss_background"], r["score"]) for r in lm.cross_entropy_difference(docs, target, k, s, 2000, leave_out).where("n_words > 0").collect())
    want = []
    for i, (r, w) in enumerate(zip(rows, words)):
        seq, loss = ["<s>", *(x if x in known else "<?>" for x in w)], []
        for keep in kept:
            pair, word, context = model(keep, i if leave_out else None)
            n = sum(word.values())
            loss.append(-sum(math.log((pair[a, b] + s * (word[b] + 1) / (n + k + 1)) / (context[a] + s)) for a, b in zip(seq, seq[1:])) / max(1, len(w)))
        if w:
            want.append((str(r[0]), len(w), *loss, loss[0] - loss[1]))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    empty = lm.cross_entropy_difference(docs, target, k, s).where("n_words = 0").collect()
    assert len(empty) == len(rows) - len(want) and {r["score"] for r in empty} == {None}
    assert lm.cross_entropy_difference(none, target).count() == 0
    assert lm.cross_entropy_difference(docs, target.limit(0), k).count() == len(rows)


def test_cross_entropy_difference_counts_rare_words(spark):
    texts = [" ".join(f"often{i}" for i in range(9000))] * 2 + ["rare one rare two", "rare one rare two", "odd three odd four", "", None] + ["rare one"] * 300
    target = spark.createDataFrame([(2,), (1,)], "doc_id long")
    words = [(t or "").split() for t in texts]
    vocabulary, models = {w for x in words for w in x}, []
    for keep in ({1, 2}, set(range(len(texts)))):
        seqs = [["<s>", *words[i]] for i in keep]
        models.append((Counter(p for x in seqs for p in zip(x, x[1:])), Counter(w for x in seqs for w in x[1:]), Counter(w for x in seqs for w in x[:-1])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["loss_target"], r["loss_background"]) for r in lm.cross_entropy_difference(docs, target, block_bytes=2000, leave_out=False).collect()}
    for i, w in enumerate(words):
        want = (None, None)
        if w:
            want = tuple(-sum(math.log((p[a, b] + 100 * (n[b] + 1) / (n.total() + len(vocabulary) + 1)) / (c[a] + 100)) for a, b in zip(["<s>", *w], w)) / len(w) for p, n, c in models)
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert got[2][0] - got[2][1] < got[4][0] - got[4][1]


def test_documents_that_occur_twice_stand_out(spark):
    """Their words are known from the copy; those of a document that is alone in its words are not."""
    texts = [" ".join(f"w{(i * 7919 + j * 104729) % 20011}" for j in range(80)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    got = {r["doc_id"]: r["loss_background"] for r in lm.cross_entropy_difference(docs, docs.limit(0).select("doc_id")).collect()}
    twice = {*range(5), *range(40, 45)}
    assert max(got[i] for i in twice) < min(got[i] for i in got if i not in twice)
