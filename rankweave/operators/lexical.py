"""Term matching by cover density.

Postings of the query's lexemes are gathered per query and document; a document's score sums, over its minimal spans
that hold all of the query's lexemes it has, 1 for spans of up to SPAN words and SPAN over the length for longer ones
(Clarke, Cormack and Tudhope, Relevance ranking for one to three term queries).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexemes, query_lexemes

SPAN = 16
#: Documents that the anchors of a coverage-graded match may have in all, where a request names no budget.
DF_BUDGET = 2000
#: Rows of a table that may be sent to every task.
BROADCAST_ROWS = 20_000
#: Queries that every row may look at.
ROWWISE = 64
#: Scores are rounded so that the order of additions never splits a tie.
DIGITS = 6


@dataclass(frozen=True)
class Terms:
    """Lexemes of a batch of queries: a table of query_id, lex, term (0-based) and n_terms.

    items has the lexemes of each query if there are few enough to go to every task, else it is None.
    """

    table: DataFrame
    items: list[tuple[int, list[str]]] | None

    @property
    def few(self) -> bool:
        """Whether every row may look at every query."""
        return self.items is not None and len(self.items) <= ROWWISE and sum(len(w) for _, w in self.items) <= 8 * ROWWISE

    def words(self) -> list[str]:
        return sorted({w for _, ws in self.items or [] for w in ws})

    def bounded(self, hits: DataFrame, cap: int) -> DataFrame:
        """A table of at most cap rows a query, marked for broadcast if that is few rows."""
        return F.broadcast(hits) if self.items is not None and len(self.items) * cap <= BROADCAST_ROWS else hits


def query_terms(spark: SparkSession, queries: DataFrame | list[tuple[int, str]] | Terms) -> Terms:
    """Lexemes of queries (query_id, text).  A batch of up to BROADCAST_ROWS lexemes is sent to the tasks, so that
    documents are matched where they are read; a larger one is joined by lexeme."""
    if isinstance(queries, Terms):
        return queries
    if isinstance(queries, list):
        items = [(q, query_lexemes(text)) for q, text in queries]
    else:
        lex = F.array_distinct(lexemes(F.col("text")))
        table = queries.select("query_id", F.posexplode(lex).alias("term", "lex"), F.size(lex).alias("n_terms"))
        rows = table.limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS:
            return Terms(table, None)
        found: dict[int, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["query_id"], r["term"])):
            found.setdefault(r["query_id"], []).append(r["lex"])
        items = list(found.items())
    rows = [(q, i, w, len(ws)) for q, ws in items for i, w in enumerate(ws)]
    return Terms(F.broadcast(spark.createDataFrame(rows, "query_id long, term int, lex string, n_terms int")), [x for x in items if x[1]])


def postings(rows: DataFrame) -> DataFrame:
    """(source_id, word, lex) of rows (source_id, text)."""
    return rows.select("source_id", F.posexplode(lexemes(F.col("text"))).alias("word", "lex"))


def scored(rows: DataFrame, terms: Terms, keep: list[str]) -> DataFrame:
    """What matches() gives, from rows (source_id, text) and a few queries, and the columns in keep: every row is
    matched where it is read, and nothing is shuffled."""
    hit = F.filter(F.transform(lexemes(F.col("text")), lambda x, i: F.struct(i.alias("word"), x.alias("lex"))), lambda h: h["lex"].isin(terms.words()))
    queries = F.array(*(F.struct(F.lit(q).cast("long").alias("query_id"), F.array(*map(F.lit, words)).alias("lex")) for q, words in terms.items or []))
    # the generators keep the expensive expressions from being written out, and computed, twice
    found = rows.select("source_id", *keep, F.explode(F.array(hit)).alias("all")).where(F.size("all") > 0).select("source_id", *keep, "all", F.explode(queries).alias("q"))
    mine = F.filter(F.transform("all", lambda h: F.struct(h["word"].alias("word"), (F.array_position(F.col("q.lex"), h["lex"]) - 1).cast("int").alias("term"), h["lex"].alias("lex"))), lambda h: h["term"] >= 0)
    found = found.select("source_id", *keep, F.col("q.query_id").alias("query_id"), F.size("q.lex").alias("n_terms"), F.explode(F.array(mine)).alias("hits")).where(F.size("hits") > 0)
    found = found.withColumn("terms", F.array_distinct(F.transform("hits", lambda x: x["lex"]))).withColumn("coverage", F.size("terms"))
    return found.select("query_id", "source_id", *keep, "n_terms", "terms", "coverage", cover_density(F.col("hits"), F.col("coverage"), F.col("n_terms")).alias("score"))


def cover_density(hits: Column, coverage: Column, n_terms: Column) -> Column:
    """Score of sorted hits (array of structs word, term) over the `coverage` terms that occur."""
    start = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("last"), F.lit(-1).alias("left"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda v, i: F.when(i == x["term"], x["word"]).otherwise(v))
        seen = F.filter(last, lambda v: v >= 0)
        left = F.array_min(seen)
        length = x["word"] - left + 1
        new = (F.size(seen) == coverage) & (left != acc["left"])
        worth = F.when(length <= SPAN, F.lit(1.0)).otherwise(F.lit(float(SPAN)) / length)
        return F.struct(last.alias("last"), F.when(new, left).otherwise(acc["left"]).alias("left"), (acc["score"] + F.when(new, worth).otherwise(F.lit(0.0))).alias("score"))

    return F.aggregate(hits, start, step, lambda acc: F.round(acc["score"], DIGITS))


def matches(postings: DataFrame, terms: Terms) -> DataFrame:
    """query_id, source_id, n_terms, terms (the query's lexemes that occur), coverage (how many) and score.

    Only postings of query lexemes are shuffled, by query and document.
    """
    found = postings.join(terms.table, "lex").groupBy("query_id", "source_id", "n_terms").agg(F.array_sort(F.collect_list(F.struct("word", "term", "lex"))).alias("hits"))
    found = found.withColumn("terms", F.array_distinct(F.transform("hits", lambda x: x["lex"]))).withColumn("coverage", F.size("terms"))
    return found.select("query_id", "source_id", "n_terms", "terms", "coverage", cover_density(F.col("hits"), F.col("coverage"), F.col("n_terms")).alias("score"))


def ranked(listing: DataFrame, order: list[Column], cap: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds pos and keeps the first cap of each query; Spark cuts each partition first."""
    return listing.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= cap)


def match_all(found: DataFrame, cap: int) -> DataFrame:
    """Documents with every lexeme of the query, best score first; ties go to the smaller id."""
    return ranked(found.where("coverage = n_terms"), [F.desc("score"), F.asc("source_id")], cap)


def anchors(found: DataFrame, budget: int | None) -> DataFrame:
    """Terms that a coverage-graded match starts from: the rarest first while the sum of their document frequencies
    stays within the budget, and always the rarest one, ties in the
    order of the lexemes.  query_id, lex, df."""
    budget = DF_BUDGET if budget is None else budget
    df = found.select("query_id", F.explode("terms").alias("lex")).groupBy("query_id", "lex").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "lex")
    return df.select("query_id", "lex", "df", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(order).alias("nth")).where((F.col("nth") == 1) | (F.col("total") <= budget)).select("query_id", "lex", "df")


def match_graded(found: DataFrame, cap: int, budget: int | None = None, few: bool = False) -> DataFrame:
    """Documents with an anchor and at least one other lexeme (any document with the lexeme of a one-lexeme query): most
    lexemes first, then best score, so that the documents of match_all come first.  Of few queries the anchors, a row for
    each, go to the tasks, and the matches stay where they are."""
    sets = anchors(found, budget).groupBy("query_id").agg(F.collect_set("lex").alias("anchors"))
    sets = F.broadcast(sets) if few else sets
    admitted = found.join(sets, "query_id").where(F.arrays_overlap("terms", "anchors") & ((F.col("coverage") >= 2) | (F.col("n_terms") == 1))).drop("anchors")
    return ranked(admitted, [F.desc("coverage"), F.desc("score"), F.asc("source_id")], cap)


def widened(found: DataFrame, cap: int, budget: int | None = None, few: bool = False) -> DataFrame:
    """cascade(match_all(found, cap), match_graded(found, cap, budget), cap): as the rows of match_all come first among
    those of match_graded, and in the same order, it is the latter with its partial matches told apart."""
    return match_graded(found, cap, budget, few).withColumn("appended", F.col("coverage") < F.col("n_terms"))


def cascade(first: DataFrame, second: DataFrame, cap: int, terms: Terms | None = None) -> DataFrame:
    """Appends to each query's thin first listing the rows of the second that it lacks, up to cap rows in all.

    The first listing's rows keep their places.  Adds appended (boolean).
    """
    small = terms.bounded if terms is not None else lambda df, _: df
    n = small(first.groupBy("query_id").agg(F.count("*").alias("n1")), 1)
    ids = small(first.select("query_id", "source_id"), cap)
    rest = second.join(ids, ["query_id", "source_id"], "left_anti").join(n, "query_id", "left").withColumn("n1", F.coalesce("n1", F.lit(0))).where(F.col("n1") < cap)
    rest = rest.withColumn("pos", (F.col("n1") + F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).cast("int")).where(F.col("pos") <= cap)
    return first.withColumn("appended", F.lit(False)).unionByName(rest.drop("n1").withColumn("appended", F.lit(True)))
