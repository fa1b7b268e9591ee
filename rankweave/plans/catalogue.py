"""Named queries over the test tables, and the SQL that each is held against.

The tables have no clock and no vectors of texts: a document's time is that of the event with its number, NOW is fixed,
and a stored vector stands in for an embedded query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import provenance as P
from ..functions import text as X
from ..functions.times import millis
from ..operators import floors, fusion, lexical, recency, rollup, vector
from ..schema import EMBEDDINGS, LEXICAL, Filters, Params, Recency, Request
from ..sources.storage import scratch
from ..sources.tables import TableSource
from ..streaming import health
from . import legs as L
from . import policy, retrieval
from .embedding import EmbedTimeoutError
from .oracle import Sql

NOW = 1704326400000  # 2024-01-04T00:00:00Z
MONTH_END = 1706659200000  # 2024-01-31T00:00:00Z
DAY = 86_400_000
COMMON, PAIR, RARE = "the", "the and", "the tionre onesnt"
RECENT = Recency(half_life_ms=DAY, weight=0.3, now_ms=NOW)
MULTIPLY = Recency(half_life_ms=DAY, weight=0.5, mode="multiply", now_ms=NOW)
FRESH = Recency(half_life_ms=DAY, weight=0.3, fresh_window_ms=DAY // 2, now_ms=NOW)
FLOORS = {"lexical": 1.5, "embeddings": 0.1}
BATCH = [(1, "tionre onesnt"), (2, "the tionre"), (3, "that onesnt"), (4, "and")]
BATCH_VECTORS = {1: 0, 2: 7, 3: 20}  # query -> vec_id


# ---------------------------------------------------------------- sources


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> TableSource:
    times = read(spark, sf_dir, "events").groupBy(F.col("event_id").cast("string").alias("source_id")).agg(millis(F.max("ts")).alias("ts_ms"))
    table = read(spark, sf_dir, "documents")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").cast("array<double>").alias("v"))
    c = F.col
    return TableSource("documents", table, c("doc_id"), c("text"), ts_ms=c("ts_ms"), scope=c("source"), kind=c("lang"), meta={"lang": c("lang")}, vectors=vectors, times=times)


def conversations(spark: SparkSession, sf_dir: str) -> TableSource:
    c = F.col
    name = F.concat_ws(":", c("conv_id"), c("turn"))
    return TableSource("conversations", read(spark, sf_dir, "conversations"), name, c("text"), speaker=c("role"), session=c("conv_id").cast("string"), owner=c("role"), meta={"conv": c("conv_id")})


def pages(spark: SparkSession, sf_dir: str) -> TableSource:
    c = F.col
    return TableSource("pages", read(spark, sf_dir, "pages"), c("page_id"), X.plain(c("html")), meta={"url": c("url")})


def stored_vectors(spark: SparkSession, sf_dir: str, ids: list[int]) -> dict[int, list[float]]:
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", F.col("embedding").cast("array<double>"))
    return {r[0]: list(r[1]) for r in rows.collect()}


def stored_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return stored_vectors(spark, sf_dir, [vec_id])[vec_id]


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _one(text: str) -> list[tuple[int, str]]:
    return [(0, text)]


def _pos(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- lexical


@query(Sql().lexical(RARE).ands(30).out("SELECT source_id, score, pos FROM ands"))
def lex_and_topk(spark, sf_dir):
    hits = documents(spark, sf_dir).lexical(Params(30), _one(RARE))
    return _pos(hits.select("source_id", "score", "pos"))


@query(Sql().lexical(COMMON).ands(50).out("SELECT source_id, score, pos FROM ands"))
def lex_single_term(spark, sf_dir):
    return _pos(documents(spark, sf_dir).lexical(Params(50), _one(COMMON)).select("source_id", "score", "pos"))


@query(Sql().lexical(RARE).out("SELECT source_id, coverage, score FROM lx"))
def cover_density_all(spark, sf_dir):
    found = documents(spark, sf_dir).matches(Params(10), _one(RARE))
    return found.select("source_id", F.col("coverage").cast("long").alias("coverage"), "score")


@query(Sql().lexical(RARE).graded(100, lexical.DF_BUDGET).out("SELECT source_id, coverage, score, pos FROM graded"))
def coverage_graded(spark, sf_dir):
    hits = lexical.match_graded(documents(spark, sf_dir).matches(Params(100), _one(RARE)), 100, few=True)
    return _pos(hits.select("source_id", F.col("coverage").cast("long").alias("coverage"), "score", "pos"))


@query(Sql().lexical(RARE).graded(100, 100).out("SELECT source_id, coverage, score, pos FROM graded"))
def anchor_budget(spark, sf_dir):
    hits = lexical.match_graded(documents(spark, sf_dir).matches(Params(100), _one(RARE)), 100, 100, few=True)
    return _pos(hits.select("source_id", F.col("coverage").cast("long").alias("coverage"), "score", "pos"))


@query(Sql().lexical(RARE).anchors(0).out("SELECT lex, df FROM anchors"))
def anchor_single_rarest(spark, sf_dir):
    return lexical.anchors(documents(spark, sf_dir).matches(Params(100), _one(RARE)), 0).select("lex", "df")


@query(Sql().cosine(0).nearest(20).out("SELECT source_id, score, pos FROM near"))
def vec_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").cast("array<double>").alias("v"))
    return _pos(vector.nearest(vectors, [(0, stored_vector(spark, sf_dir))], 20).select("source_id", "score", "pos"))


# ---------------------------------------------------------------- full text


_MULTI = Sql().lexical(PAIR, "documents", "d_").ands(15, "d_").lexical(PAIR, "conversations", "c_").ands(15, "c_").lexical(PAIR, "pages", "p_").ands(15, "p_")


@query(_MULTI.out("SELECT *, row_number() OVER (ORDER BY score DESC, src, p) AS pos FROM (SELECT 'documents' AS source, source_id, score, 0 AS src, pos AS p FROM d_ands UNION ALL SELECT 'conversations', source_id, score, 1, pos FROM c_ands UNION ALL SELECT 'pages', source_id, score, 2, pos FROM p_ands) QUALIFY pos <= 15", drop=("src", "p")))
def fulltext_multi(spark, sf_dir):
    sources = [documents(spark, sf_dir), conversations(spark, sf_dir), pages(spark, sf_dir)]
    request = Request(query=PAIR, limit=15, lexical_cascade=False, materialize_legs=False)
    ranking, _, _ = retrieval.fulltext_ranking(spark, sources, request, _one(PAIR))
    return _pos(rollup.cut(ranking, 15).select("source", "source_id", "score", "pos"))


@query(_MULTI.out("SELECT (SELECT count(*) FROM d_ands) + (SELECT count(*) FROM c_ands) + (SELECT count(*) FROM p_ands) AS total_hits"))
def fulltext_total(spark, sf_dir):
    sources = [documents(spark, sf_dir), conversations(spark, sf_dir), pages(spark, sf_dir)]
    ranking, _, _ = retrieval.fulltext_ranking(spark, sources, Request(query=PAIR, limit=15, lexical_cascade=False, materialize_legs=False), _one(PAIR))
    return ranking.agg(F.count("*").alias("total_hits"))


@query(Sql().lexical(PAIR, "documents", "", f"lang = 'en' AND source = 'src7' AND ts_ms >= {NOW - 5 * DAY // 2} AND ts_ms < {NOW - DAY // 2}").ands(20).out("SELECT source_id, score, pos FROM ands"))
def fulltext_filtered(spark, sf_dir):
    f = Filters(source_kind="en", since=NOW - 5 * DAY // 2, until=NOW - DAY // 2, speaker="nobody")  # documents have no speaker: ignored
    return _pos(documents(spark, sf_dir).lexical(Params(20, scope="src7", filters=f), _one(PAIR)).select("source_id", "score", "pos"))


@query(Sql().lexical(PAIR, "conversations", "", "role IN ('assistant') AND role = 'assistant' AND conv_id = 3").ands(20).out("SELECT source_id, score, pos FROM ands"))
def fulltext_owner_session(spark, sf_dir):
    f = Filters(owners=("assistant",), speaker="assistant", session_id="3")
    return _pos(conversations(spark, sf_dir).lexical(Params(20, filters=f), _one(PAIR)).select("source_id", "score", "pos"))


# ---------------------------------------------------------------- cascade


_CASCADE = Sql().lexical(RARE).ands(40).graded(40, lexical.DF_BUDGET).cascade(40)


@query(_CASCADE.out("SELECT source_id, score, pos, appended FROM cascaded"))
def cascade_append(spark, sf_dir):
    return _pos(documents(spark, sf_dir).lexical(Params(40), _one(RARE), cascade=True).select("source_id", "score", "pos", "appended"))


@query(Sql().lexical(PAIR).ands(10).graded(10, lexical.DF_BUDGET).cascade(10).out("SELECT source_id, score, pos, appended FROM cascaded"))
def cascade_full_no_fire(spark, sf_dir):
    return _pos(documents(spark, sf_dir).lexical(Params(10), _one(PAIR), cascade=True).select("source_id", "score", "pos", "appended"))


@query(_CASCADE.out("SELECT count(*) FILTER (WHERE appended) AS stage2_added, count(*) AS candidates FROM cascaded"))
def cascade_added_count(spark, sf_dir):
    hits = documents(spark, sf_dir).lexical(Params(40), _one(RARE), cascade=True)
    return hits.agg(F.count_if("appended").alias("stage2_added"), F.count("*").alias("candidates"))


# ---------------------------------------------------------------- hybrid


def _hybrid(spark, sf_dir, limit=10, text=RARE, **options) -> DataFrame:
    request = Request(query=text, limit=limit, **options)
    return retrieval.hybrid_batch(spark, [documents(spark, sf_dir)], request, _one(text), [(0, stored_vector(spark, sf_dir))])


def _shown(ranking: DataFrame) -> DataFrame:
    return _pos(ranking.select("key", F.round("score", 9).alias("score"), "pos", F.array_join("rankers", ",").alias("rankers"), F.col("ranker_scores")[LEXICAL].alias("lexical_score"), F.col("ranker_scores")[EMBEDDINGS].alias("semantic_score")))


def _fused(limit: int, floor: bool = False, fresh: bool = False, text: str = RARE, lexical_leg: bool = True) -> Sql:
    sql, cap = Sql(), retrieval.OVERFETCH * limit
    if lexical_leg:
        sql.lexical(text).ands(cap).graded(cap, lexical.DF_BUDGET).cascade(cap).listing("cascaded", LEXICAL, 0, FLOORS["lexical"] if floor else None)
    if fresh:
        sql.lexical(text, "documents", "f_", f"ts_ms >= {NOW - DAY // 2}").ands(cap, "f_").fresh("f_ands", recency.fresh_seats(limit))
    sql.cosine(0, "vec_id IN (SELECT doc_id FROM documents)").nearest(cap).listing("near", EMBEDDINGS, 2, FLOORS["embeddings"] if floor else None)
    return sql.fuse()


@query(_fused(10).out("SELECT key, round(score, 9) AS score, pos, rankers, lexical_score, semantic_score FROM fused WHERE pos <= 10"))
def rrf_hybrid(spark, sf_dir):
    return _shown(rollup.cut(_hybrid(spark, sf_dir), 10))


@query(_fused(10, lexical_leg=False).out("SELECT key, round(score, 9) AS score, pos, rankers, lexical_score, semantic_score FROM fused WHERE pos <= 10"))
def rrf_embeddings_only(spark, sf_dir):
    return _shown(rollup.cut(_hybrid(spark, sf_dir, mode="embeddings"), 10))


@query(_fused(10).out("SELECT count(*) AS total_hits FROM fused"))
def rrf_total_hits(spark, sf_dir):
    return _hybrid(spark, sf_dir).agg(F.count("*").alias("total_hits"))


@query(_fused(20, floor=True).out("SELECT key, round(score, 9) AS score, pos, rankers, lexical_score, semantic_score FROM fused"))
def floors_pre_fusion(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir, 20, min_score=FLOORS))


@query(Sql().cosine(0).nearest(100).out("SELECT count(*) FILTER (WHERE score >= 0.1) AS candidates, count(*) FILTER (WHERE score < 0.1) AS dropped FROM near"))
def floors_dropped_counts(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").cast("array<double>").alias("v"))
    near = vector.nearest(vectors, [(0, stored_vector(spark, sf_dir))], 100)
    return floors.floor_counts(near, floors.resolve_floor(FLOORS, EMBEDDINGS)).select("candidates", "dropped")


@query(Sql().lexical(PAIR, "documents", "", f"ts_ms >= {NOW - DAY}").ands(60).out("SELECT source_id, score, row_number() OVER (ORDER BY pos) AS pos FROM ands WHERE score >= 2.5"))
def floors_family(spark, sf_dir):
    floor = floors.resolve_floor({"lexical": 2.5}, "lexical-fresh")  # the family's
    hits = documents(spark, sf_dir).lexical(Params(60, filters=Filters(since=NOW - DAY)), _one(PAIR))
    return _pos(floors.apply_floor(hits, floor).select("query_id", "source_id", "score", "pos").drop("query_id"))


# ---------------------------------------------------------------- recency


_TIMES = "SELECT f.*, d.ts_ms FROM fused f JOIN docs_all d ON f.key = 'documents:' || d.source_id"


def _blended(sql: Sql, blend: str) -> str:
    fade = f"CASE WHEN ts_ms IS NULL THEN 0e0 ELSE power(0.5e0, greatest(0e0, {NOW}e0 - ts_ms) / {DAY}e0) END"
    return sql.out(f"""SELECT key, round(blend, 9) AS score, row_number() OVER (ORDER BY blend DESC, pos) AS pos, rankers || CASE WHEN ts_ms IS NULL THEN '' ELSE ',recency' END AS rankers
        FROM (SELECT *, round({blend.format(fade=fade)}, 12) AS blend FROM ({_TIMES}))""")


_LINEAR = "(1 - 0.3e0) * (1 - percent_rank() OVER (ORDER BY score DESC)) + 0.3e0 * ({fade})"


@query(_blended(_fused(10), _LINEAR))
def recency_linear(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir, recency=RECENT)).select("key", "score", "pos", "rankers")


@query(_blended(_fused(10), "score / max(score) OVER () * power({fade}, 0.5e0)"))
def recency_multiply(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir, recency=MULTIPLY)).select("key", "score", "pos", "rankers")


@query(_blended(_fused(10, fresh=True, text=PAIR), _LINEAR))
def fresh_leg(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir, text=PAIR, recency=FRESH)).select("key", "score", "pos", "rankers")


@query(f"SELECT event_id, round(CASE WHEN ts IS NULL THEN 0e0 ELSE power(0.5e0, greatest(0e0, {MONTH_END - 10 * DAY}e0 - epoch_us(ts) // 1000) / {3 * DAY}e0) END, 9) AS decay FROM events")
def time_decay(spark, sf_dir):
    from ..functions.times import decay

    return read(spark, sf_dir, "events").select("event_id", F.round(decay(millis(F.col("ts")), MONTH_END - 10 * DAY, 3 * DAY), 9).alias("decay"))


# ---------------------------------------------------------------- groups, provenance, headlines


_TURNS = Sql().lexical(PAIR, "conversations").ands(200)


def _turns(spark, sf_dir) -> DataFrame:
    source = conversations(spark, sf_dir)
    return source.attached(source.lexical(Params(200), _one(PAIR)), Params(200), True)


@query(_TURNS.out("SELECT source_id, score, row_number() OVER (ORDER BY pos) AS pos FROM (SELECT *, split_part(source_id, ':', 1) AS g FROM ands QUALIFY row_number() OVER (PARTITION BY g ORDER BY pos) = 1) QUALIFY row_number() OVER (ORDER BY pos) <= 25"))
def group_top(spark, sf_dir):
    hits = _turns(spark, sf_dir)
    return _pos(rollup.first_of_groups(hits, F.col("meta")["conv"], 25).select("source_id", "score", "pos"))


@query(_TURNS.out("SELECT count(DISTINCT CASE WHEN g <> '1' THEN g END) + count(*) FILTER (WHERE g = '1') AS total_groups FROM (SELECT split_part(source_id, ':', 1) AS g FROM ands)"))
def group_count(spark, sf_dir):
    hits = _turns(spark, sf_dir)
    group = F.when(F.col("meta")["conv"] != "1", F.col("meta")["conv"])  # conversation 1 counts as ungrouped rows
    return rollup.group_counts(hits, group).select("total_groups")


@query(_fused(10).out("""SELECT key, CASE WHEN lexical_score IS NOT NULL AND semantic_score IS NOT NULL THEN 'both' WHEN lexical_score IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS matched_by,
    lexical_score, semantic_score, lexical_score IS NULL AS vector_only FROM fused"""))
def provenance(spark, sf_dir):
    ranking = _hybrid(spark, sf_dir)
    return ranking.select("key", *(c.alias(n) for n, c in P.provenance(F.col("rankers"), F.col("ranker_scores")).items()), P.is_vector_only(F.col("rankers"), F.col("ranker_scores")).alias("vector_only"))


def _headline_sql(text: str, words: list[str]) -> str:
    """The headline in another engine's regular expressions, which have no look-around: borders are matched along."""
    any_, edge = "|".join(sorted(words, key=len, reverse=True)), "[^\\p{L}\\p{N}]"
    lead = f"regexp_extract({text}, '(?si)^(.*?)(?:^|{edge})(?:{any_})(?:{edge}|$)', 1)"
    hit = f"regexp_matches({text}, '(?si)(?:^|{edge})(?:{any_})(?:{edge}|$)')"
    at = f"CASE WHEN NOT {hit} THEN 0 WHEN regexp_matches({text}, '(?si)^(?:{any_})(?:{edge}|$)') THEN 1 ELSE length({lead}) + 2 END"
    before = f"CASE WHEN spot > {X.LEAD + 1} THEN regexp_replace(substring({text}, spot - {X.LEAD}, {X.LEAD}), '^[\\p{{L}}\\p{{N}}]+', '') ELSE substring({text}, 1, spot - 1) END"
    after = f"CASE WHEN length({text}) >= spot + {X.EXCERPT - X.LEAD} THEN regexp_replace(substring({text}, spot, {X.EXCERPT - X.LEAD}), '[\\p{{L}}\\p{{N}}]+$', '') ELSE substring({text}, spot, {X.EXCERPT - X.LEAD}) END"
    mark = "x"
    for _ in range(2):  # a border that two words share serves one at a time; what is marked has none left
        border = "[^\\p{L}\\p{N}\\x{E000}\\x{E001}]"
        mark = f"regexp_replace({mark}, '(?i)(^|{border})({any_})({border}|$)', '\\1' || chr(57344) || '\\2' || chr(57345) || '\\3', 'g')"
    mark = f"replace(replace({mark}, chr(57344), '<mark>'), chr(57345), '</mark>')"
    return f"(SELECT CASE WHEN spot > 0 THEN {mark} ELSE substring({text}, 1, {X.EXCERPT}) END FROM (SELECT spot, {before} || {after} AS x FROM (SELECT {at} AS spot)))"


@query(_fused(10).out(f"SELECT key, {_headline_sql('text', X.query_lexemes(RARE))} AS highlight FROM fused f JOIN docs_all d ON f.key = 'documents:' || d.source_id WHERE pos <= 10"))
def highlight(spark, sf_dir):
    source, request = documents(spark, sf_dir), Request(query=RARE, defer_highlight=True)
    page = rollup.cut(_hybrid(spark, sf_dir), 10).withColumn("highlight", F.lit(""))
    return retrieval.highlighted(retrieval._held(spark, page, True), [source], X.query_lexemes(RARE), request).select("key", "highlight")


@query(f"SELECT doc_id, {_headline_sql('text', ['onesnt', 'tionre'])} AS highlight FROM documents")
def headlines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.headline(F.col("text"), ["onesnt", "tionre"]).alias("highlight"))


@query("SELECT doc_id, substring(text, 1, 200) AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


# ---------------------------------------------------------------- legs, health


@query(_fused(20, floor=True).out(f"""SELECT leg, candidates, floored, stage2_added, CASE WHEN candidates > 0 OR floored > 0 THEN 'ran' ELSE 'not-run' END AS status FROM (
    SELECT 'lexical' AS leg, count(*) FILTER (WHERE score >= {FLOORS["lexical"]}) AS candidates, count(*) FILTER (WHERE score < {FLOORS["lexical"]}) AS floored, count(*) FILTER (WHERE appended) AS stage2_added FROM cascaded
    UNION ALL SELECT 'semantic', count(*) FILTER (WHERE score >= {FLOORS["embeddings"]}), count(*) FILTER (WHERE score < {FLOORS["embeddings"]}), 0 FROM near)"""))
def legs_report(spark, sf_dir):
    request, vectors = Request(query=RARE, limit=20, min_score=FLOORS), lambda: [(0, stored_vector(spark, sf_dir))]
    pool = retrieval.gather(spark, [documents(spark, sf_dir)], request, _one(RARE), 60, "hybrid", FLOORS, None, NOW, vectors)
    return _legs_table(spark, retrieval.report(pool, request)).select("leg", "candidates", "floored", "stage2_added", "status")


def _legs_table(spark, legs: L.Legs) -> DataFrame:
    """A row for each leg of a report."""
    rows = [(name, leg.status, leg.candidates, leg.floored, leg.stage2_added, leg.calls_run, leg.calls_failed, L.failure_text(leg.failures), leg.blocked, legs.degraded, legs.warning) for name, leg in (("lexical", legs.lexical), ("semantic", legs.semantic))]
    return spark.createDataFrame(rows, "leg string, status string, candidates long, floored long, stage2_added long, calls_run long, calls_failed long, failures string, blocked string, degraded boolean, warning string")


class _Broken(TableSource):
    """A source that fails: at once, or (late) only when its rows are read."""

    late = False

    def matches(self, p, queries):
        if not self.late:
            raise RuntimeError("no index here")
        return super().matches(p, queries).withColumn("score", F.when(F.col("score") >= 0, F.raise_error(F.lit("boom")).cast("double")))

    def embedding(self, *_):
        raise RuntimeError("no vectors here")


def _broken(source: TableSource, name: str, late: bool = False) -> TableSource:
    out = _Broken(name, source.table, source.id, source.text, vectors=source.vectors)
    out.late = late
    return out


def _samples(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    flags = {"degraded": kind == "error", "lexical_blocked": F.col("value") > 90, "semantic_blocked": F.col("value") < 1, "lexical_empty": kind == "view", "semantic_empty": kind == "click"}
    return read(spark, sf_dir, "events").select("event_id", millis(F.col("ts")).alias("at_ms"), F.col("ts").cast("timestamp").alias("at"), *(c.alias(n) for n, c in flags.items()))


_SAMPLES = "SELECT epoch_us(ts) // 1000 AS at_ms, ts, event_type = 'error' AS degraded, value > 90 AS lexical_blocked, value < 1 AS semantic_blocked, event_type = 'view' AS lexical_empty, event_type = 'click' AS semantic_empty FROM events"
_FLAG_COUNTS = ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in health.FLAGS)


@query(f"SELECT count(*) AS samples, {_FLAG_COUNTS}, min(at_ms) AS oldest_ms, max(at_ms) AS newest_ms, round(count(*) FILTER (WHERE degraded) / count(*)::DOUBLE, 9) AS degraded_rate FROM ({_SAMPLES}) WHERE at_ms >= {MONTH_END - 10 * DAY} AND at_ms <= {MONTH_END}")
def leg_health(spark, sf_dir):
    return health.trailing_health(_samples(spark, sf_dir), 10 * DAY, MONTH_END).withColumn("degraded_rate", F.round("degraded_rate", 9))


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS samples, {_FLAG_COUNTS}, round(count(*) FILTER (WHERE degraded) / count(*)::DOUBLE, 9) AS degraded_rate FROM ({_SAMPLES}) GROUP BY 1")
def leg_health_windows(spark, sf_dir):
    out = health.windowed_health(_samples(spark, sf_dir), "1 day")
    return out.drop("window_end").withColumns({"degraded_rate": F.round("degraded_rate", 9), "window_start": F.col("window_start").cast("timestamp_ntz")})


# ---------------------------------------------------------------- batches


def _batch_sql() -> str:
    sql = Sql()
    for q, text in BATCH:
        sql.lexical(text, "documents", f"q{q}_").ands(30, f"q{q}_").graded(30, lexical.DF_BUDGET, f"q{q}_").cascade(30, f"q{q}_").listing(f"q{q}_cascaded", LEXICAL, 0, query=q)
        if q in BATCH_VECTORS:
            sql.cosine(BATCH_VECTORS[q], "vec_id IN (SELECT doc_id FROM documents)", f"q{q}_").nearest(30, f"q{q}_").listing(f"q{q}_near", EMBEDDINGS, 2, query=q)
    return sql.fuse().out("SELECT query_id, key, round(score, 9) AS score, pos, rankers FROM fused WHERE pos <= 10")


@query(_batch_sql())
def batch_rrf(spark, sf_dir):
    stored = stored_vectors(spark, sf_dir, list(BATCH_VECTORS.values()))
    ranking = retrieval.hybrid_batch(spark, [documents(spark, sf_dir)], Request(limit=10), BATCH, [(q, stored[v]) for q, v in BATCH_VECTORS.items()])
    return _pos(rollup.cut(ranking, 10).select("query_id", "key", F.round("score", 9).alias("score"), "pos", F.array_join("rankers", ",").alias("rankers")))


@query(_fused(10).out("SELECT round(sum(round(1e0 / (60 + pos), 12)), 9) AS mass, max(pos) AS longest, count(*) AS entries FROM entries"))
def rrf_entries(spark, sf_dir):
    pool = retrieval.gather(spark, [documents(spark, sf_dir)], Request(query=RARE, limit=10, materialize_legs=False), _one(RARE), 30, "hybrid", {}, None, NOW, lambda: [(0, stored_vector(spark, sf_dir))])
    entries = pool.listings[0].unionByName(pool.listings[1])
    return entries.agg(F.round(F.sum(F.round(F.lit(1.0) / (fusion.K + F.col("pos")), 12)), 9).alias("mass"), F.max("pos").cast("long").alias("longest"), F.count("*").alias("entries"))


# ---------------------------------------------------------------- whole requests


def _embedder(spark, sf_dir):
    """An embedder that gives a stored vector for any text."""
    vector = stored_vector(spark, sf_dir)
    return lambda _: vector


def _page(result: retrieval.Result) -> DataFrame:
    return _pos(result.hits.select("key", "pos", F.round("score", 9).alias("score"), F.array_join("rankers", ",").alias("rankers"), "excerpt", F.lit(result.total_hits).cast("long").alias("total_hits"), F.lit(result.embedder_available).alias("embedder_available")))


_PAGE = "SELECT key, pos, round(score, 9) AS score, rankers, substring(text, 1, 200) AS excerpt, (SELECT count(*) FROM fused) AS total_hits, true AS embedder_available FROM fused JOIN docs_all d ON key = 'documents:' || d.source_id WHERE pos <= 10"


@query(_fused(10).out(_PAGE))
def hybrid_run(spark, sf_dir):
    return _page(retrieval.run_hybrid(spark, [documents(spark, sf_dir)], Request(query=RARE, limit=10, embedder=_embedder(spark, sf_dir))))


@query(_fused(10).out("""SELECT key, row_number() OVER (ORDER BY pos) AS pos, round(score, 9) AS score, lang, count(*) OVER () AS total_groups
    FROM (SELECT key, pos, score, lang FROM fused JOIN docs_all d ON key = 'documents:' || d.source_id QUALIFY row_number() OVER (PARTITION BY lang ORDER BY pos) = 1)"""))
def hybrid_run_grouped(spark, sf_dir):
    r = retrieval.run_hybrid(spark, [documents(spark, sf_dir)], Request(query=RARE, limit=10, embedder=_embedder(spark, sf_dir), group_by=F.col("meta")["lang"]))
    return _pos(r.hits.select("key", "pos", F.round("score", 9).alias("score"), F.col("meta")["lang"].alias("lang"), F.lit(r.total_groups).cast("long").alias("total_groups")))


@query(_blended(_fused(10), "(1 - 1e0) * (1 - percent_rank() OVER (ORDER BY score DESC)) + 1e0 * ({fade})").replace("docs_all d ON", "(SELECT source_id, ts_ms - 86400000 AS ts_ms FROM docs_all) d ON"))
def recency_custom_time(spark, sf_dir):
    late = Recency(half_life_ms=DAY, weight=7.0, now_ms=NOW, time=F.col("ts_ms") - DAY)  # the weight is clamped to 1
    return _shown(_hybrid(spark, sf_dir, recency=late)).select("key", "score", "pos", "rankers")


@query(Sql().lexical(PAIR, "documents", "", "source = 'src3'").ands(20).out("SELECT source_id, score, pos FROM ands"))
def fulltext_tenant(spark, sf_dir):
    source = documents(spark, sf_dir)
    source.tenant, source.scope = F.col("source"), None
    return _pos(source.lexical(Params(20, workspace_id="src3", scope="ignored"), _one(PAIR)).select("source_id", "score", "pos"))


@query(Sql().lexical(RARE).ands(30).out("SELECT source_id, score, pos FROM ands"))
def lex_indexed(spark, sf_dir):
    return _pos(documents(spark, sf_dir).indexed(scratch(spark)).lexical(Params(30), _one(RARE)).select("source_id", "score", "pos"))


_DEGRADED_WARNING = "2 lexical source call(s) failed: broken (no index here), late (boom); 2 semantic source call(s) failed: broken (no vectors here), late (no vectors here)"


@query(_fused(10).out(f"""SELECT leg, 'ran' AS status, candidates, 0 AS floored, stage2_added, 1 AS calls_run, 2 AS calls_failed, failures, NULL::VARCHAR AS blocked, true AS degraded, '{_DEGRADED_WARNING}' AS warning FROM (
    SELECT 'lexical' AS leg, count(*) AS candidates, count(*) FILTER (WHERE appended) AS stage2_added, 'broken (no index here), late (boom)' AS failures FROM cascaded
    UNION ALL SELECT 'semantic', count(*), 0, 'broken (no vectors here), late (no vectors here)' FROM near)"""))
def degraded_run(spark, sf_dir):
    """A source that fails at once and one that fails when it is read are reported, and the other one goes on."""
    good = documents(spark, sf_dir)
    sources = [_broken(good, "broken"), _broken(good, "late", late=True), good]
    r = retrieval.run_hybrid(spark, sources, Request(query=RARE, limit=10, embedder=_embedder(spark, sf_dir)))
    fixed = lambda c: F.regexp_replace(c, r"\[USER_RAISED_EXCEPTION\] (boom) SQLSTATE: P0001", "$1")
    return _legs_table(spark, r.legs).withColumns({"failures": fixed("failures"), "warning": fixed("warning")})


_LATE = str(EmbedTimeoutError(1))


@query(_fused(10).out(f"""SELECT leg, status, candidates, 0 AS floored, stage2_added, calls_run, 0 AS calls_failed, '' AS failures, blocked, true AS degraded, 'semantic leg blocked: query embed failed: {_LATE}' AS warning FROM (
    SELECT 'lexical' AS leg, 'ran' AS status, count(*) AS candidates, count(*) FILTER (WHERE appended) AS stage2_added, 1 AS calls_run, NULL::VARCHAR AS blocked FROM cascaded
    UNION ALL SELECT 'semantic', 'errored', 0, 0, 0, 'query embed failed: {_LATE}')"""))
def embed_timeout_run(spark, sf_dir):
    import time

    r = retrieval.run_hybrid(spark, [documents(spark, sf_dir)], Request(query=RARE, limit=10, embedder=lambda _: time.sleep(30), embed_timeout_ms=1))
    return _legs_table(spark, r.legs)


@query(_fused(20, floor=True).out(f"""SELECT line FROM (
    SELECT 'lexical documents minScore {FLOORS["lexical"]:g} dropped ' || count(*) FILTER (WHERE score < {FLOORS["lexical"]}) || '/' || count(*) AS line, count(*) FILTER (WHERE score < {FLOORS["lexical"]}) AS n FROM cascaded
    UNION ALL SELECT 'embeddings documents minScore {FLOORS["embeddings"]:g} dropped ' || count(*) FILTER (WHERE score < {FLOORS["embeddings"]}) || '/' || count(*), count(*) FILTER (WHERE score < {FLOORS["embeddings"]}) FROM near) WHERE n > 0"""))
def log_lines(spark, sf_dir):
    said: list[str] = []
    retrieval.run_hybrid(spark, [documents(spark, sf_dir)], Request(query=RARE, limit=20, embedder=_embedder(spark, sf_dir), min_score=FLOORS, log=said.append))
    return spark.createDataFrame([(x,) for x in said], "line string")


@query(_fused(20, floor=True).out(f"""SELECT * FROM (VALUES ('policy', (SELECT count(*) FROM fused), {FLOORS["embeddings"]}::DOUBLE, false, true), ('off', (SELECT count(DISTINCT source_id) FROM (SELECT source_id FROM cascaded UNION ALL SELECT source_id FROM near)), NULL, false, true),
    ('value', (SELECT count(DISTINCT source_id) FROM (SELECT source_id FROM cascaded UNION ALL SELECT source_id FROM near WHERE score >= 0.2)), 0.2, false, true), ('reset', (SELECT count(DISTINCT source_id) FROM (SELECT source_id FROM cascaded UNION ALL SELECT source_id FROM near)), NULL, false, false)) AS t(given, total_hits, floor, recency, policy_registered)"""))
def policy_runs(spark, sf_dir):
    """What a registered policy, a value, False, and no policy put in force."""
    source, embedder, rows = documents(spark, sf_dir), _embedder(spark, sf_dir), []
    before = policy.defaults_host()
    seen: list[policy.PolicyContext] = []
    try:
        policy.configure_defaults(policy.Defaults(min_score=lambda c: seen.append(c) or FLOORS, recency=lambda c: 1 / 0))
        for given, value in (("policy", {}), ("off", {"min_score": False}), ("value", {"min_score": {"embeddings": 0.2}}), ("reset", {})):
            if given == "reset":
                policy.reset_defaults()
            r = retrieval.run_hybrid(spark, [source], Request(query=RARE, limit=20, embedder=embedder, **value))
            rows.append((given, r.total_hits, (r.applied.min_score or {}).get("embeddings"), r.applied.recency, r.applied.policy_registered))
    finally:
        policy.reset_defaults() if before is None else policy.configure_defaults(before)
    if [c.embedder is embedder for c in seen] != [True]:
        raise AssertionError("a resolver is asked once, where no value is given, and is told the embedder itself")
    return spark.createDataFrame(rows, "given string, total_hits long, floor double, recency boolean, policy_registered boolean")


_GRID = "(SELECT * FROM range(2) a(attempted), range(2) b(blocked), range(3) c(run), range(3) d(failed), range(2) e(candidates), range(2) f(floored))"


def _grid_rows() -> list[tuple]:
    from itertools import product

    out = []
    for at, bl, run, failed, cand, floored in product(range(2), range(2), range(3), range(3), range(2), range(2)):
        a = L.LegAccumulator(bool(at), cand, floored, 0, run, failed, [("s", "e")] * failed, "late" if bl else None)
        lexical, other = L.finalise_leg(a), L.finalise_leg(L.LegAccumulator(True, 1, 0, 0, 1))
        both = L.summarise_legs(lexical, other)
        mirrored = L.summarise_legs(other, lexical)
        sample, mirror = health.sample_of_legs(both, 0), health.sample_of_legs(mirrored, 0)
        out.append((at, bl, run, failed, cand, floored, lexical.status, both.degraded, both.warning, mirrored.warning, sample.lexical_blocked, sample.lexical_empty, mirror.semantic_blocked, mirror.semantic_empty))
    return out


_STATUS = "CASE WHEN attempted = 0 THEN 'not-run' WHEN blocked = 1 OR (run = 0 AND failed > 0) THEN 'errored' WHEN run = 0 THEN 'not-run' ELSE 'ran' END"
_SAID = """nullif(concat_ws('; ', CASE WHEN blocked = 1 THEN '{leg} leg blocked: late' END, CASE WHEN blocked = 0 AND status = 'errored' THEN 'every {leg} source call failed: ' || failures END,
    CASE WHEN {empty} AND candidates = 0 THEN '{leg} leg contributed 0 candidates' || CASE WHEN floored > 0 THEN ' (the score floor removed all ' || floored || ')' ELSE '' END || ': the result is {other}-only' END,
    CASE WHEN failed > 0 AND run > 0 THEN failed || ' {leg} source call(s) failed: ' || failures END), '')"""


@query(f"""WITH g AS (SELECT *, {_STATUS} AS status, CASE failed WHEN 0 THEN '' WHEN 1 THEN 's (e)' ELSE 's (e), s (e)' END AS failures FROM {_GRID}),
    s AS (SELECT *, {_SAID.format(leg="lexical", other="semantic", empty="status <> 'not-run'")} AS warning, {_SAID.format(leg="semantic", other="lexical", empty="status <> 'not-run' AND blocked = 0")} AS mirrored FROM g)
    SELECT * EXCLUDE (failures), warning IS NOT NULL AS degraded, blocked = 1 AS lexical_blocked, status = 'ran' AND candidates = 0 AS lexical_empty, blocked = 1 AS semantic_blocked, status = 'ran' AND candidates = 0 AS semantic_empty FROM s""")
def leg_states(spark, sf_dir):
    """Status, warnings and health sample of a leg in every state, beside a leg that works."""
    names = "attempted long, blocked long, run long, failed long, candidates long, floored long, status string, degraded boolean, warning string, mirrored string, lexical_blocked boolean, lexical_empty boolean, semantic_blocked boolean, semantic_empty boolean"
    return spark.createDataFrame(_grid_rows(), names)


@query("""SELECT 16 AS samples, (SELECT count(*) FROM benchmark) AS observed, count(*) FILTER (WHERE d) AS degraded, count(*) FILTER (WHERE d) AS lexical_empty, true AS truncated, 0 AS after_reset
    FROM (SELECT item_id % 3 = 0 AS d FROM benchmark ORDER BY item_id DESC LIMIT 16)""")
def health_ring(spark, sf_dir):
    """A ring of 16 samples after a request for each benchmark item, of which every third found nothing by its terms."""
    ring, fine = health.LegHealthRing(16), L.LegReport("ran", 1, calls_run=1)
    for r in read(spark, sf_dir, "benchmark").select("item_id").orderBy("item_id").collect():
        ring.observe(L.summarise_legs(L.LegReport("ran", min(1, r["item_id"] % 3), calls_run=1), fine), NOW + r["item_id"])
    now, observed = ring.read(DAY, NOW + DAY // 2), ring.observed
    ring.reset()
    return spark.createDataFrame([(now.samples, observed, now.degraded, now.lexical_empty, now.truncated, ring.observed)], "samples long, observed long, degraded long, lexical_empty long, truncated boolean, after_reset long")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.1f', floor(64 * x::DOUBLE))), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, sf_dir):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", X.vector_literal(whole).alias("literal"))
