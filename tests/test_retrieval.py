"""Both entry points over small tables: merging, degradation, abort, budgets, policy, leg reports and health."""

import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from rankweave.operators import lexical
from rankweave.plans import legs as L
from rankweave.plans import catalogue, policy, retrieval
from rankweave.plans.embedding import EmbedTimeoutError, Embedding
from rankweave.schema import Aborted, Filters, Params, Recency, Request, Signal
from rankweave.sources.tables import TableSource
from rankweave.streaming import health

DAY = 86_400_000
NOW = 1_700_000_000_000
NOTES = [(1, "red fox runs", "a", NOW - 30 * DAY), (2, "red red fox", "a", NOW - 20 * DAY), (3, "red house", "b", NOW), (4, "blue fox", "b", NOW - DAY), (5, "nothing", None, None)]
VECTORS = [("1", [1.0, 0.0]), ("3", [0.8, 0.6]), ("5", [0.0, 1.0])]


@pytest.fixture(scope="module")
def notes(spark):
    table = spark.createDataFrame(NOTES, "id long, body string, owner string, at long").cache()
    vectors = spark.createDataFrame(VECTORS, "source_id string, v array<double>").cache()
    c = F.col
    return TableSource("notes", table, c("id"), c("body"), ts_ms=c("at"), owner=c("owner"), scope=c("owner"), vectors=vectors, meta={"owner": c("owner")})


@pytest.fixture(autouse=True)
def clean():
    policy.reset_defaults()
    health.reset_leg_health()


class Broken(TableSource):
    def matches(self, *_):
        raise RuntimeError("no index here")

    def embedding(self, *_):
        raise RuntimeError("no vectors here")

    def highlights(self, *_):
        raise RuntimeError("no headlines here")


def broken(notes):
    return Broken("bad", notes.table, notes.id, notes.text, vectors=notes.vectors)


def ids(result):
    return [r["source_id"] for r in result.hits.orderBy("pos").collect()]


def test_full_text_ranks_by_native_score_and_counts_before_the_cut(spark, notes):
    r = retrieval.run_full_text(spark, [notes], Request(query="red fox", limit=1, lexical_cascade=False))
    assert ids(r) == ["2"] or ids(r) == ["1"]
    wide = retrieval.run_full_text(spark, [notes], Request(query="red fox runs", limit=5))
    rows = wide.hits.orderBy("pos").collect()
    assert {x["source_id"] for x in rows} == {"1", "2"} and wide.total_hits == 2 and wide.legs.lexical.stage2_added == 1
    assert max(x["highlight"].count("<mark>") for x in rows) == 3 and wide.legs.semantic.status == "not-run"
    assert wide.applied == policy.Applied() and not wide.legs.degraded


def test_same_id_in_two_sources_is_two_rows(spark, notes):
    twin = TableSource("twin", notes.table, notes.id, notes.text)
    r = retrieval.run_full_text(spark, [notes, twin], Request(query="house", limit=5))
    assert [(x["source"], x["source_id"]) for x in r.hits.orderBy("pos").collect()] == [("notes", "3"), ("twin", "3")]


def test_filters_that_a_source_lacks_are_ignored(spark, notes):
    f = Filters(owners=("b",), speaker="me", session_id="s", source_kind="k", since=NOW - DAY, until=NOW)
    r = retrieval.run_full_text(spark, [notes], Request(query="fox", limit=5, filters=f))
    assert ids(r) == ["4"]
    assert ids(retrieval.run_full_text(spark, [notes], Request(query="fox", limit=5, scope="a", workspace_id="w"))) == ["1", "2"]


def test_hybrid_fuses_both_rankers(spark, notes):
    r = retrieval.run_hybrid(spark, [notes], Request(query="red fox", limit=3, embedder=lambda _: [1.0, 0.0], min_score={"embeddings": 0.5}, group_by=F.col("meta")["owner"]))
    rows = r.hits.orderBy("pos").collect()
    assert rows[0]["source_id"] == "1" and rows[0]["rankers"] == ["lexical", "embeddings"] and rows[0]["ranker_scores"]["embeddings"] == 1.0
    assert r.embedder_available and r.legs.semantic.floored == 1 and r.legs.semantic.candidates == 2 and r.total_groups == 2 and len(rows) == 2
    assert r.applied == policy.Applied({"embeddings": 0.5}) and health.leg_health_observed_count() == 1


def test_embeddings_mode_without_a_vector_is_empty_and_healthy(spark, notes):
    r = retrieval.run_hybrid(spark, [notes], Request(query="red", mode="embeddings"))
    assert ids(r) == [] and r.total_hits == 0 and not r.legs.degraded and r.embedder_available is False


def test_recency_and_the_fresh_leg_lift_a_starved_row(spark):
    rows = [(i, "red " * (12 - i), NOW - 30 * DAY) for i in range(1, 8)] + [(9, "red", NOW - DAY // 24)]
    table = spark.createDataFrame(rows, "id long, body string, at long")
    source = TableSource("t", table, F.col("id"), F.col("body"), ts_ms=F.col("at"))
    base = dict(query="red", limit=2, lexical_cascade=False)
    without = retrieval.run_hybrid(spark, [source], Request(**base, recency=Recency(DAY, 0.3, now_ms=NOW)))
    fresh = retrieval.run_hybrid(spark, [source], Request(**base, recency=Recency(DAY, 0.3, fresh_window_ms=2 * DAY, now_ms=NOW)))
    assert "9" not in ids(without) and ids(fresh)[0] == "9" and fresh.applied.recency


def test_a_broken_source_degrades_and_the_others_go_on(spark, notes):
    said = []
    r = retrieval.run_hybrid(spark, [broken(notes), notes], Request(query="red fox", limit=3, embedder=lambda _: [1.0, 0.0], log=said.append, defer_highlight=True))
    assert ids(r)[0] == "1" and r.legs.degraded and r.legs.lexical.calls_failed == 1 and "bad (no index here)" in r.legs.warning
    assert any("headlines" in m for m in said)
    alone = retrieval.run_full_text(spark, [broken(notes)], Request(query="red"))
    assert alone.legs.lexical.status == "errored" and "every lexical source call failed" in alone.legs.warning


def test_failures_at_run_time_degrade_by_default(spark, notes):
    bad = notes.table.withColumn("body", F.when(F.col("id") > 0, F.raise_error(F.lit("boom"))).otherwise(F.col("body")))
    source = TableSource("late", bad, F.col("id"), F.col("body"))
    r = retrieval.run_full_text(spark, [source, notes], Request(query="house"))
    assert ids(r) == ["3"] and r.legs.lexical.calls_failed == 1 and "boom" in r.legs.warning
    with pytest.raises(Exception, match="boom"):
        retrieval.run_full_text(spark, [source, notes], Request(query="house", materialize_legs=False))


def test_a_fresh_call_counts_as_run(spark, notes):
    class Main(TableSource):
        def lexical(self, p, queries, cascade=False, ranker="lexical", input_ord=0):
            if ranker == "lexical":
                raise RuntimeError("main is away")
            return super().lexical(p, queries, cascade, ranker, input_ord)

    source = Main("half", notes.table, notes.id, notes.text, ts_ms=notes.ts_ms)
    r = retrieval.run_hybrid(spark, [source], Request(query="fox", limit=4, recency=Recency(DAY, 0.3, fresh_window_ms=2 * DAY, now_ms=NOW)))
    assert (r.legs.lexical.status, r.legs.lexical.calls_run, r.legs.lexical.calls_failed) == ("ran", 1, 1) and ids(r) == ["4"]
    whole = retrieval.run_hybrid(spark, [notes], Request(query="fox", limit=4, recency=Recency(DAY, 0.3, fresh_window_ms=2 * DAY, now_ms=NOW)))
    assert whole.legs.lexical.calls_run == 2


def test_the_embedder_runs_beside_the_term_legs(spark, notes):
    looked = threading.Event()

    class Seen(TableSource):
        def matches(self, p, queries):
            looked.set()
            return super().matches(p, queries)

    source = Seen("notes", notes.table, notes.id, notes.text, vectors=notes.vectors)
    r = retrieval.run_hybrid(spark, [source], Request(query="red fox", embedder=lambda _: [1.0, 0.0] if looked.wait(60) else []))
    assert r.embedder_available and r.legs.semantic.candidates == 3  # in turn, the embedder would have waited in vain


def test_headlines_at_once_or_for_the_page_only(spark, notes):
    asked = []

    class Counting(TableSource):
        def rows(self, p):
            asked.append(p.want_highlight)
            return super().rows(p)

        def highlights(self, ids, words):
            asked.append("page")
            return super().highlights(ids, words)

    def of(**options):
        return Counting("notes", notes.table, notes.id, notes.text, **options)

    shown = {}
    for defer in (False, True):
        r = retrieval.run_full_text(spark, [of()], Request(query="red fox", limit=2, defer_highlight=defer))
        shown[defer] = {x["source_id"]: x["highlight"] for x in r.hits.collect()}
    assert shown[False] == shown[True] and all("<mark>" in h for h in shown[True].values())
    assert asked == [None, False, "page"]
    asked.clear()
    r = retrieval.run_hybrid(spark, [of(hydrates=False)], Request(query="red fox", limit=2, defer_highlight=True))
    assert asked == [None] and all("<mark>" in x["highlight"] for x in r.hits.collect())  # can't give them later: gave them at once
    kept = retrieval.run_full_text(spark, [of(), broken(notes)], Request(query="zzz red", limit=2, defer_highlight=True, lexical_mode="and"))
    assert ids(kept) == []


def test_no_sources_and_a_mode_that_is_the_default(spark, notes):
    for run in (retrieval.run_full_text, retrieval.run_hybrid):
        r = run(spark, [], Request(query="red"))
        assert r.hits.collect() == [] and r.total_hits == 0 and not r.legs.degraded and r.legs.lexical.status == "not-run"
    assert Request(query="q", lexical_mode="and").params(1).lexical_mode is None
    r = retrieval.run_full_text(spark, [notes], Request(query="red fox runs", lexical_mode="and"))
    assert ids(r) == ["1"] and r.legs.lexical.stage2_added == 0  # a caller's mode turns the widening off


def test_health_samples_what_was_blocked(spark, notes):
    failed = L.summarise_legs(leg(attempted=True, calls_failed=1, failures=[("s", "e")]), leg(attempted=True, calls_run=1, candidates=2))
    sample = health.sample_of_legs(failed, NOW)
    assert failed.lexical.status == "errored" and sample.degraded and not sample.lexical_blocked and not sample.lexical_empty
    assert health.sample_of_legs(L.summarise_legs(leg(), leg(attempted=True, blocked="late")), NOW).semantic_blocked


def test_a_failed_embedding_blocks_only_the_semantic_leg(spark, notes):
    def fails(_):
        raise RuntimeError("model is away")

    r = retrieval.run_hybrid(spark, [notes], Request(query="red fox", limit=2, embedder=fails))
    assert r.legs.semantic.blocked == "query embed failed: model is away" and r.legs.semantic.status == "errored" and ids(r)
    assert "semantic leg blocked" in r.legs.warning and not r.embedder_available
    slow = retrieval.run_hybrid(spark, [notes], Request(query="red fox", limit=2, embedder=lambda _: time.sleep(60), embed_timeout_ms=1))
    assert "exceeded 1ms budget" in slow.legs.semantic.blocked


def test_embedding_budget_starts_at_once_and_zero_is_unbounded():
    began = threading.Event()
    e = Embedding(lambda _: began.set() or time.sleep(0.1) or [1.0], "q")
    assert began.wait(5) and e.result(0) == [1.0]
    with pytest.raises(EmbedTimeoutError) as failure:
        Embedding(lambda _: time.sleep(5), "q").result(30)
    assert failure.value.budget_ms == 30
    with pytest.raises(ValueError):
        Embedding(lambda _: [], "q").result()


def test_an_embedder_that_ends_after_its_budget_is_late_whenever_it_is_asked_for():
    for late in (lambda _: time.sleep(0.2) or [1.0], lambda _: time.sleep(0.2), lambda _: time.sleep(0.2) or 1 / 0):
        e = Embedding(late, "q")
        assert e._done.wait(30)  # as after a term leg that takes longer than the embedder
        with pytest.raises(EmbedTimeoutError):
            e.result(1)
        with pytest.raises(EmbedTimeoutError):
            e.result(100)
    prompt = Embedding(lambda _: [1.0], "q")
    time.sleep(0.6)
    assert prompt.result(500) == [1.0]  # asked for late, but it was there in time


def test_abort_never_gives_a_partial_result(spark, notes):
    signal = Signal()
    signal.abort()
    for run in (retrieval.run_full_text, retrieval.run_hybrid):
        with pytest.raises(Aborted):
            run(spark, [notes], Request(query="red", signal=signal))
    late = Signal()
    threading.Timer(0.2, late.abort).start()
    with pytest.raises(Aborted):
        retrieval.run_hybrid(spark, [notes], Request(query="red", signal=late, embedder=lambda _: time.sleep(30)))


def test_policy_gives_way_to_values_and_to_off(spark, notes):
    seen = []
    embedder = lambda _: [1.0, 0.0]
    policy.configure_defaults(policy.Defaults(min_score=lambda c: seen.append(c) or {"embeddings": 0.9}))
    base = dict(query="zzz", limit=5, embedder=embedder)
    assert ids(retrieval.run_hybrid(spark, [notes], Request(**base))) == ["1"]
    assert seen[0].embedder is embedder and (seen[0].mode, seen[0].limit) == ("hybrid", 5)
    assert len(ids(retrieval.run_hybrid(spark, [notes], Request(**base, min_score=False)))) == 3
    assert len(ids(retrieval.run_hybrid(spark, [notes], Request(**base, min_score={"embeddings": 0.5})))) == 2
    policy.configure_defaults(policy.Defaults(recency=lambda c: 1 / 0))
    assert policy.defaults_host().min_score is None  # replaced, not merged
    assert retrieval.run_hybrid(spark, [notes], Request(**base)).applied == policy.Applied(policy_registered=True)


def leg(**k):
    return L.finalise_leg(L.LegAccumulator(**k))


def test_leg_status():
    assert leg().status == "not-run" and leg(attempted=True).status == "not-run"
    assert leg(attempted=True, calls_run=1).status == "ran" and leg(attempted=True, calls_run=1, calls_failed=2).status == "ran"
    assert leg(attempted=True, calls_failed=2).status == "errored" and leg(attempted=True, blocked="x", calls_run=1).status == "errored"
    assert [L.leg_of_ranker(r) for r in ("lexical-fresh", "bm25", "embeddings", "other")] == ["lexical", "lexical", "semantic", "semantic"]
    assert not L.empty_legs().degraded


def test_leg_summary():
    ran = dict(attempted=True, calls_run=1)
    assert L.summarise_legs(leg(**ran, candidates=2), leg(**ran, candidates=1)).warning is None
    assert not L.summarise_legs(leg(**ran), leg(**ran)).degraded  # both empty is healthy
    assert "semantic-only" in L.summarise_legs(leg(**ran), leg(**ran, candidates=1)).warning
    assert "lexical-only" in L.summarise_legs(leg(**ran, candidates=1), leg(**ran)).warning
    assert "the score floor removed all 4" in L.summarise_legs(leg(**ran, floored=4), leg(**ran, candidates=1)).warning
    blocked = L.summarise_legs(leg(**ran, candidates=1), leg(attempted=True, blocked="late")).warning
    assert blocked == "semantic leg blocked: late"
    many = leg(attempted=True, calls_run=1, calls_failed=5, candidates=1, failures=[(f"s{i}", "e") for i in range(5)])
    assert "5 lexical source call(s) failed: s0 (e), s1 (e), s2 (e) +2 more" in L.summarise_legs(many, leg()).warning


def test_health_ring():
    legs = L.summarise_legs(leg(attempted=True, calls_run=1), leg(attempted=True, calls_run=1, candidates=1))
    for i in range(health.CAPACITY + 50):
        assert health.observe_legs(legs, NOW + i) is legs
    h = health.read_leg_health(DAY, NOW + 600)
    assert (h.samples, h.degraded_rate, h.truncated, h.lexical_empty) == (512, 1.0, True, 512) and health.leg_health_observed_count() == 562
    assert health.read_leg_health(1, NOW + DAY).degraded_rate is None and health.observe_legs(None) is None


def test_health_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    rows = [(NOW + i * 60_000, i % 3 == 0, False, i % 5 == 0, False, False) for i in range(200)]
    table = spark.createDataFrame(rows, "at_ms long, degraded boolean, lexical_blocked boolean, semantic_blocked boolean, lexical_empty boolean, semantic_empty boolean").withColumn("at", F.timestamp_millis("at_ms"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = health.windowed_health(stream, "1 hour", "30 minutes")
    q = out.writeStream.format("memory").queryName("leg_health_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("leg_health_test").collect()) == sorted(health.windowed_health(table, "1 hour", "30 minutes").collect())
    one = health.trailing_health(table, 10 * 60_000, NOW + 199 * 60_000).first()
    assert one["samples"] == 11
    assert health.trailing_health(table, 1, NOW - DAY).first()["degraded_rate"] is None


def test_neither_texts_nor_matches_are_shuffled_for_a_page(spark, tmp_path):
    """Times are joined to the hits, and the anchors of few queries go to the matches, whatever may be broadcast unasked."""
    spark.createDataFrame([(i, f"red fox {i}" if i % 2 else "red", "en", "src1", 7) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i * 1000) for i in range(10)], "event_id long, ms long").select("event_id", F.timestamp_millis("ms").alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    source = catalogue.documents(spark, str(tmp_path))
    hits = spark.createDataFrame([("documents", str(i), i) for i in (3, 9, 15)], "source string, source_id string, pos int")
    unasked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = source.attached(hits, Params(5, words=("fox",)), True)
        plan = spark._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
        shuffled = re.findall(r"\) Exchange\nInput[^\n]*", plan)
        assert shuffled and not any("text#" in x for x in shuffled)
        rows = {r["source_id"]: (r["ts_ms"], r["pos"], r["meta"]["lang"], r["highlight"]) for r in page.collect()}
        assert rows == {"3": (3000, 3, "en", "red <mark>fox</mark> 3"), "9": (9000, 9, "en", "red <mark>fox</mark> 9"), "15": (None, 15, "en", "red <mark>fox</mark> 15")}
        graded = source.lexical(Params(3), [(0, "red fox")], cascade=True)
        assert "SortMergeJoin" not in graded._jdf.queryExecution().executedPlan().toString()
        assert [r["source_id"] for r in graded.orderBy("pos").collect()] == ["1", "11", "13"]
        timely = source.lexical(Params(9, filters=Filters(since=3000, until=9000)), [(0, "fox")])
        assert [r["source_id"] for r in timely.orderBy("pos").collect()] == ["3", "5", "7"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", unasked)


def test_index_of_postings_gives_the_same_listing(spark, notes, tmp_path):
    indexed = TableSource("notes", notes.table, notes.id, notes.text, owner=notes.owner).indexed(str(tmp_path / "index"))
    read = indexed._postings(Request(query="red fox").params(1), lexical.query_terms(spark, [(0, "red fox")]))
    assert "In(lex, [fox,red])" in read._jdf.queryExecution().executedPlan().toString()  # pushed down to the files
    plain = TableSource("notes", notes.table, notes.id, notes.text, owner=notes.owner)
    request = Request(query="red fox", limit=5, filters=Filters(owners=("a",)))
    assert ids(retrieval.run_full_text(spark, [indexed], request)) == ids(retrieval.run_full_text(spark, [plain], request))
