"""Operators on small listings: floors, fusion, recency, rollup, provenance and the lexical match."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.functions import provenance as P
from rankweave.functions import text as X
from rankweave.functions.times import to_millis
from rankweave.operators import floors, fusion, lexical, recency, rollup, vector
from rankweave.schema import Recency

DAY = 86_400_000
NOW = 1_700_000_000_000


def listing(spark, rows, ranker="lexical", input_ord=0, ts=None):
    """rows: (id, score) in order."""
    ts = ts or {}
    data = [(0, "s", str(i), f"s:{i}", ranker, input_ord, n + 1, float(v), ts.get(i), None, str(i), None, {"g": str(i)[0]}) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(data, "query_id long, source string, source_id string, key string, ranker string, input_ord int, pos int, score double, ts_ms long, scope string, excerpt string, rerank_score double, meta map<string,string>")


def ids(df):
    return [r["source_id"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("entries", "ranker", "floor"),
    [({"lexical": 0.5}, "lexical", 0.5), ({"lexical": 0.5}, "lexical-fresh", 0.5), ({"lexical": 0.5, "lexical-fresh": 0.1}, "lexical-fresh", 0.1), ({}, "lexical", None), ({"lexical": math.nan}, "lexical", None), ({"lexical": 0.0}, "lexical", 0.0), ({"a": math.inf}, "a", math.inf), ({"": 1.0}, "-x", None), ({"lexical-fresh": math.nan, "lexical": 2.0}, "lexical-fresh", 2.0)],
)
def test_floor_resolution(entries, ranker, floor):
    assert floors.resolve_floor(entries, ranker) == floor


def test_floor_is_inclusive_and_tightens_positions(spark):
    rows = [("a", 0.9), ("x", math.nan), ("b", 0.5), ("c", 0.1)]
    kept = floors.apply_floor(listing(spark, rows), 0.5)
    assert [(r["source_id"], r["pos"]) for r in kept.orderBy("pos").collect()] == [("a", 1), ("b", 2)]
    assert ids(floors.apply_floor(listing(spark, rows), 0.0)) == ["a", "b", "c"]
    assert ids(floors.apply_floor(listing(spark, rows), None)) == ["a", "x", "b", "c"]
    assert tuple(floors.floor_counts(listing(spark, rows), 0.5).first())[1:] == (2, 2)
    assert "lexical docs minScore 0.5 dropped 2/4" in floors.floor_message("lexical", "docs", 0.5, 2, 4)


def test_fusion_sums_ranks_and_breaks_ties_by_input_order(spark):
    a = listing(spark, [("1", 9), ("2", 1)])
    b = listing(spark, [("3", 0.7), ("1", 0.6)], "embeddings", 2)
    rows = fusion.fuse([a, b]).orderBy("pos").collect()
    assert [r["source_id"] for r in rows] == ["1", "3", "2"]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and rows[0]["rankers"] == ["lexical", "embeddings"]
    assert rows[0]["ranker_scores"] == {"lexical": 9.0, "embeddings": 0.6} and rows[0]["source"] == "s"
    tied = fusion.fuse([listing(spark, [("x", 0.1)]), listing(spark, [("y", 99)], "embeddings", 2)])
    assert ids(tied) == ["x", "y"]  # native scores don't count


def test_fusion_counts_a_repeated_key_once(spark):
    twice = listing(spark, [("1", 5), ("1", 4), ("2", 3)])
    rows = {r["source_id"]: r for r in fusion.fuse([twice]).collect()}
    assert rows["1"]["score"] == pytest.approx(1 / 61) and rows["1"]["ranker_scores"] == {"lexical": 5.0}


def fused(spark, scores, ts):
    return listing(spark, [(str(i), s) for i, s in enumerate(scores)], ts={str(i): t for i, t in enumerate(ts)}).withColumns({"rankers": F.array(F.lit("lexical")), "ranker_scores": F.create_map(F.lit("lexical"), "score")}).drop("ranker", "input_ord")


def test_recency_weights(spark):
    pair = fused(spark, [1.0, 0.6], [NOW - 30 * DAY, NOW])
    assert ids(recency.rerank(pair, Recency(DAY, 0.7), NOW)) == ["1", "0"]
    tied = recency.rerank(pair, Recency(DAY, 0.5), NOW).orderBy("pos").collect()
    assert [r["source_id"] for r in tied] == ["0", "1"] and tied[1]["score"] == pytest.approx(0.5)
    same = recency.rerank(pair, Recency(DAY, 0.0), NOW).orderBy("pos").collect()
    assert [r["score"] for r in same] == [1.0, 0.0] and same[0]["rankers"] == ["lexical"]
    assert recency.rerank(fused(spark, [0.3], [NOW - 3 * DAY]), Recency(DAY, 0.25), NOW).first()["score"] == pytest.approx(0.75 + 0.25 / 8)


@pytest.mark.parametrize("n", [15, 45, 90])
def test_recency_does_not_depend_on_the_pool_size(spark, n):
    pool = fused(spark, [1 / (61 + i) for i in range(n)], [NOW - 90 * DAY] * (n - 1) + [NOW])
    assert ids(recency.rerank(pool, Recency(DAY, 0.6), NOW))[0] == str(n - 1)
    assert ids(recency.rerank(pool, Recency(DAY, 0.4), NOW))[0] == "0"


def test_recency_moves_rows_by_a_bounded_number_of_ranks(spark):
    n, w, rng = 21, 0.25, random.Random(3)
    pool = fused(spark, [1 / (61 + i) for i in range(n)], [NOW - rng.randint(0, 9) * DAY for _ in range(n)])
    moved = [abs(place - int(i)) for place, i in enumerate(ids(recency.rerank(pool, Recency(DAY, w), NOW)))]
    assert max(moved) <= w * (n - 1) / (1 - w)


def test_recency_multiply_and_missing_times(spark):
    rows = recency.rerank(fused(spark, [0.4, 0.2, 0.1], [None, NOW, NOW + DAY]), Recency(DAY, 1.0, "multiply"), NOW).orderBy("pos").collect()
    assert [(r["source_id"], r["score"]) for r in rows] == [("1", 0.5), ("2", 0.25), ("0", 0.0)]
    assert rows[2]["rankers"] == ["lexical"] and rows[0]["rankers"] == ["lexical", "recency"]


def test_fresh_window_and_seats(spark):
    r = Recency(DAY, 0.3, fresh_window_ms=2 * DAY)
    assert recency.fresh_since(r, "hybrid", None, NOW) == NOW - 2 * DAY
    assert recency.fresh_since(r, "embeddings", None, NOW) is None
    assert recency.fresh_since(r, "hybrid", NOW - DAY, NOW) is None
    assert recency.fresh_since(Recency(DAY, 0.0, fresh_window_ms=DAY), "hybrid", None, NOW) is None
    assert [recency.fresh_seats(n) for n in (1, 4, 10, 30)] == [1, 1, 2, 7]
    main, fresh = listing(spark, [("a", 1), ("b", 1)]), listing(spark, [("a", 1), ("c", 1), ("d", 1)], "lexical-fresh", 1)
    got = recency.fresh_rows(fresh, main, 1).collect()
    assert [(x["source_id"], x["pos"]) for x in got] == [("c", 1)]


def test_rollup_keeps_order_and_never_merges_null_groups(spark):
    rows = listing(spark, [(k, 9 - n) for n, k in enumerate(["a1", "x1", "a2", "b1", "x2"])])
    group = F.when(F.col("meta")["g"] != "x", F.col("meta")["g"])
    assert ids(rollup.first_of_groups(rows, group, 10)) == ["a1", "x1", "b1", "x2"]
    assert ids(rollup.first_of_groups(rows, group, 2)) == ["a1", "x1"]
    assert rollup.first_of_groups(rows, group, 0).count() == 0
    assert rollup.group_counts(rows, group).first()["total_groups"] == 4


@pytest.mark.parametrize(
    ("rankers", "scores", "which"),
    [(["lexical"], None, "lexical"), (["bm25"], {}, "lexical"), (["embeddings"], None, "semantic"), (["semantic-x"], None, "semantic"), (["lexical-fresh", "embeddings"], None, "both"), ([], {"lexical": 1.0, "embeddings": 2.0}, "both"), (["recency"], None, "unknown"), (None, None, "unknown")],
)
def test_provenance(spark, rankers, scores, which):
    row = spark.createDataFrame([(rankers, scores)], "r array<string>, s map<string,double>").select(*(c.alias(n) for n, c in P.provenance(F.col("r"), F.col("s")).items()), P.is_vector_only(F.col("r"), F.col("s")).alias("v")).first()
    assert row["matched_by"] == which and row["v"] == (which == "semantic")


def test_provenance_takes_the_best_lexical_leg(spark):
    row = spark.createDataFrame([(["lexical"], {"lexical": 0.2, "lexical-fresh": 0.7, "embeddings": 0.4})], "r array<string>, s map<string,double>").select(*(c.alias(n) for n, c in P.provenance(F.col("r"), F.col("s")).items())).first()
    assert (row["lexical_score"], row["semantic_score"]) == (0.7, 0.4)


def brute(words, terms):
    """Sum over minimal spans that hold all terms that the text has."""
    have = {t for t in terms if t in words}
    spans = [(p, q) for p in range(len(words)) for q in range(p, len(words)) if have <= set(words[p : q + 1])]
    minimal = [(p, q) for p, q in spans if not any((a, b) != (p, q) and p <= a and b <= q for a, b in spans)]
    return round(sum(1.0 if q - p + 1 <= 16 else 16 / (q - p + 1) for p, q in minimal), 6)


def found(spark, texts, query, rowwise=False):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_id string, text string")
    terms = lexical.query_terms(spark, spark.createDataFrame([(0, query)], "query_id long, text string"))
    return lexical.scored(rows, terms, []) if rowwise else lexical.matches(lexical.postings(rows), terms)


@pytest.mark.parametrize("rowwise", [False, True])
def test_cover_density_equals_an_enumeration_of_spans(spark, rowwise):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = {r["source_id"]: (r["coverage"], r["score"]) for r in found(spark, texts, "a B c", rowwise).collect()}
    want = {str(i): (len({*t.split()} & {*"abc"}), brute(t.split(), "abc")) for i, t in enumerate(texts) if {*t.split()} & {*"abc"}}
    assert got == want


def test_both_plans_match_a_batch_alike(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(str(i), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(50)] + [("n", None)], "source_id string, text string")
    batch = [(1, "a b"), (2, "b B h"), (3, "z"), (4, "!!"), (7, "h g f e")]
    terms = lexical.query_terms(spark, batch)
    one, two = lexical.scored(rows, terms, []), lexical.matches(lexical.postings(rows), terms)
    shown = lambda df: sorted((r["query_id"], r["source_id"], r["n_terms"], sorted(r["terms"]), r["coverage"], r["score"]) for r in df.collect())
    assert shown(one) == shown(two) and {r[0] for r in shown(one)} == {1, 2, 7}
    for cap in (1, 4, 60):
        chained = lexical.cascade(lexical.match_all(one, cap), lexical.match_graded(one, cap), cap, terms)
        columns = ["query_id", "source_id", "pos", "appended"]
        assert sorted(chained.select(columns).collect()) == sorted(lexical.widened(one, cap).select(columns).collect())


def test_graded_match_starts_with_every_full_match(spark):
    texts = ["a a a b", "a x x b", "a c", "b c", "c c c c", "a b c", "q"]
    m = found(spark, texts, "a b c")
    strict, wide = ids(lexical.match_all(m, 10)), ids(lexical.match_graded(m, 10))
    assert strict == ["5"] and wide[: len(strict)] == strict and set(wide) >= {"0", "1", "2", "3"} and "4" not in wide
    by_density = [r["source_id"] for r in m.orderBy(F.desc("score")).collect()]
    assert by_density[:1] != strict  # density alone would bury the full match
    assert [r["lex"] for r in lexical.anchors(m, 0).collect()] == ["a"]  # a and b both have df 4
    assert {r["lex"] for r in lexical.anchors(m, 8).collect()} == {"a", "b"}
    assert ids(lexical.match_graded(found(spark, texts, "q"), 5)) == ["6"]


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 9])
def test_cascade_only_appends(spark, cap):
    first = lexical.ranked(listing(spark, [("a", 1), ("b", 0.5)]).drop("pos"), [F.desc("score")], cap).select("query_id", "source_id", "score", "pos")
    second = lexical.ranked(listing(spark, [("g1", 99), ("a", 1), ("g2", 98), ("g3", 3)]).drop("pos"), [F.desc("score")], cap).select("query_id", "source_id", "score", "pos")
    out, base = ids(lexical.cascade(first, second, cap)), ids(first)
    assert out[: len(base)] == base and len(out) <= cap and len(set(out)) == len(out)
    merged = [r["source_id"] for r in first.unionByName(second).orderBy(F.desc("score")).collect()]
    assert merged[: len(base)] != base  # a merge by score would not keep the prefix


def test_vectors_of_other_lengths_are_no_candidates(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0]), ("c", [1.0]), ("d", [0.0, 0.0]), ("e", [-1.0, 0.0])], "source_id string, v array<double>")
    got = [(r["source_id"], r["score"]) for r in vector.nearest(v, [(0, [2.0, 0.0])], 5).orderBy("pos").collect()]
    assert got == [("a", 1.0), ("b", 0.6), ("e", -1.0)]


def test_text_and_time_helpers(spark):
    row = spark.createDataFrame([("The cat, the CAT's Étude x2", [1.0, 0.5])], "t string, v array<double>").select(X.lexemes(F.col("t")).alias("l"), X.headline(F.col("t"), ["cat"]).alias("h"), X.vector_literal(F.col("v")).alias("v")).first()
    assert row["l"] == ["the", "cat", "the", "cat", "s", "étude", "x2"] and row["h"].count("<mark>") == 2
    assert X.query_lexemes("The the CAT") == ["the", "cat"] and row["v"] == "[1.0,0.5]"
    assert to_millis("1970-01-01T00:00:01Z") == 1000 and to_millis("nonsense") is None and to_millis(math.inf) is None and to_millis(5) == 5


def test_headlines_are_taken_from_the_whole_document(spark):
    far = "filler " * 2000 + "then the ÉTUDE begins, étude and études " + "tail " * 100
    texts = ["no match here " * 40, far, "étude", None, "", "straße x", "x" * 500 + " cat " + "y" * 500, "cat cat,cat", "concatenate cats"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["h"] for r in df.select("i", X.headline(F.col("t"), ["étude", "straße", "cat"]).alias("h")).collect()}
    assert got[0] == texts[0][:200] and got[3] is None and got[4] == ""
    assert "the <mark>ÉTUDE</mark> begins, <mark>étude</mark> and études tail" in got[1] and got[1].startswith(" filler") and len(got[1]) <= 226
    assert got[2] == "<mark>étude</mark>" and got[5] == "<mark>straße</mark> x" and got[6] == " <mark>cat</mark> "
    assert got[7] == "<mark>cat</mark> <mark>cat</mark>,<mark>cat</mark>" and got[8] == texts[8]
