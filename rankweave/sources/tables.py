"""Tables to look through: a DataFrame and what its columns mean."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, headline
from ..operators import lexical, vector
from ..schema import EMBEDDINGS, LEXICAL, LISTING, ROW, Params


@dataclass
class TableSource:
    """A relation with up to three ways in: term match, vectors, and headlines for given ids.

    Columns are expressions over `table`; those that are None don't exist, and filters on them are ignored.  vectors has
    source_id (string) and v (array of doubles).  lexical_index may be a stored table of postings (source_id, word, lex),
    which `indexed` makes; without one a query tokenizes the rows that its filters leave.  A source that hydrates gives
    headlines for a page's ids, so it may leave them out before.  times may be a table of its own for the rows' times, with
    source_id (string) and at most one row for each; ts_ms is then an expression over it.  It is joined to hits, never to
    the whole table.
    """

    name: str
    table: DataFrame
    id: Column
    text: Column
    ts_ms: Column | None = None
    scope: Column | None = None
    tenant: Column | None = None
    owner: Column | None = None
    speaker: Column | None = None
    session: Column | None = None
    kind: Column | None = None
    rerank_score: Column | None = None
    meta: dict[str, Column] = field(default_factory=dict)
    vectors: DataFrame | None = None
    lexical_index: DataFrame | None = None
    times: DataFrame | None = None
    hydrates: bool = True

    # ---- rows

    def filtered(self, p: Params) -> DataFrame:
        """The table under the request's predicates, which stand right above the scan."""
        f, t = p.filters, self.table
        if p.workspace_id is not None and self.tenant is not None:
            t = t.where(self.tenant == F.lit(p.workspace_id))
        if p.scope is not None and self.scope is not None:
            t = t.where(self.scope == F.lit(p.scope))
        if f.owners is not None and self.owner is not None:
            t = t.where(self.owner.isin(list(f.owners)))
        for column, value in ((self.speaker, f.speaker), (self.session, f.session_id), (self.kind, f.source_kind)):
            if value is not None and column is not None:
                t = t.where(column == F.lit(value))
        if self.ts_ms is None or f.since is None and f.until is None:
            return t
        if self.times is None:
            return self._timely(t, p)
        timely = self._timely(self.times, p).select(F.col("source_id").alias("_timely"))
        return t.join(timely, self.id.cast("string") == F.col("_timely"), "left_semi")

    def _timely(self, t: DataFrame, p: Params) -> DataFrame:
        if p.filters.since is not None:
            t = t.where(self.ts_ms >= F.lit(p.filters.since))
        return t.where(self.ts_ms < F.lit(p.filters.until)) if p.filters.until is not None else t

    def ids(self, p: Params, text: bool = False) -> DataFrame:
        """source_id, and text if asked for, of the rows that the request's predicates leave."""
        return self.filtered(p).select(self.id.cast("string").alias("source_id"), *([self.text.alias("text")] if text else []))

    def _predicated(self, p: Params) -> bool:
        return self.filtered(p) is not self.table

    # ---- rankers

    def build_index(self) -> DataFrame:
        """Postings of the whole table, to be written once (see `indexed`) and given back as lexical_index."""
        return lexical.postings(self.table.select(self.id.cast("string").alias("source_id"), self.text.alias("text")))

    def indexed(self, path: str) -> TableSource:
        """This source with its postings written to path, in the order of their lexemes: a query reads the parts of
        the files that hold its own lexemes."""
        postings = self.build_index().repartitionByRange("lex", "source_id").sortWithinPartitions("lex", "source_id", "word")
        postings.write.parquet(path)
        return replace(self, lexical_index=self.table.sparkSession.read.schema(postings.schema).parquet(path))

    def _postings(self, p: Params, terms: lexical.Terms) -> DataFrame:
        if self.lexical_index is None:
            return lexical.postings(self.ids(p, text=True))
        wanted = self.lexical_index.where(F.col("lex").isin(terms.words())) if terms.few else self.lexical_index
        return wanted.join(self.ids(p), "source_id", "left_semi") if self._predicated(p) else wanted

    def matches(self, p: Params, queries: DataFrame | list[tuple[int, str]] | lexical.Terms) -> DataFrame:
        terms = lexical.query_terms(self.table.sparkSession, queries)
        if terms.few and self.lexical_index is None:
            return lexical.scored(self.ids(p, text=True), terms, [])
        return lexical.matches(self._postings(p, terms), terms)

    def lexical(self, p: Params, queries: DataFrame | list[tuple[int, str]] | lexical.Terms, cascade: bool = False, ranker: str = LEXICAL, input_ord: int = 0) -> DataFrame:
        """A term listing of at most p.limit rows of each query; cascade widens thin ones."""
        terms = lexical.query_terms(self.table.sparkSession, queries)
        found = self.matches(p, terms)
        if cascade and p.lexical_mode is None:
            hits = lexical.widened(found, p.limit, p.anchor_df_budget, terms.few)
        else:
            graded = p.lexical_mode == "coverage-graded"
            hits = (lexical.match_graded(found, p.limit, p.anchor_df_budget, terms.few) if graded else lexical.match_all(found, p.limit)).withColumn("appended", F.lit(False))
        return self._listing(hits, ranker, input_ord)

    def embedding(self, p: Params, queries: list[tuple[int, list[float]]], input_ord: int = 0) -> DataFrame:
        """The p.limit most similar rows of each query vector."""
        if self.vectors is None:
            raise LookupError(f"{self.name} has no vectors")
        hits = vector.nearest(self.vectors.join(self.ids(p), "source_id", "left_semi"), queries, p.limit)
        return self._listing(hits.withColumn("appended", F.lit(False)), EMBEDDINGS, input_ord)

    def _listing(self, hits: DataFrame, ranker: str, input_ord: int) -> DataFrame:
        constant = {"source": F.lit(self.name), "key": F.concat(F.lit(f"{self.name}:"), F.col("source_id")), "ranker": F.lit(ranker), "input_ord": F.lit(input_ord)}
        return hits.withColumns(constant).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LISTING))

    # ---- columns of hits

    def rows(self, p: Params) -> DataFrame:
        """Columns of ROW of the whole table, and highlight unless the request leaves it to `highlights`.  ts_ms is null
        where times has it."""
        null = lambda kind: F.lit(None).cast(kind)
        meta = F.map_from_arrays(F.array(*(F.lit(k) for k in self.meta)), F.array(*(c.cast("string") for c in self.meta.values()))) if self.meta else null(ROW["meta"])
        given = {"source_id": self.id, "ts_ms": self.ts_ms if self.times is None else None, "scope": self.scope, "excerpt": excerpt(self.text), "rerank_score": self.rerank_score, "meta": meta}
        shown = F.lit("") if p.want_highlight is False else headline(self.text, p.words)
        return self.table.select(*((c.cast(ROW[n]) if c is not None else null(ROW[n])).alias(n) for n, c in given.items()), shown.alias("highlight"))

    def attached(self, hits: DataFrame, p: Params, small: bool) -> DataFrame:
        """Hits of this source (source_id and any other columns) with the columns of rows(): one pass over the table, which
        isn't shuffled if the hits are few (small)."""
        rows = self.rows(p).join(F.broadcast(hits) if small else hits, "source_id")
        if self.times is None or self.ts_ms is None:
            return rows
        times = self.times.select("source_id", self.ts_ms.cast(ROW["ts_ms"]).alias("ts_ms"))
        return rows.drop("ts_ms").join(times, "source_id", "left")

    def highlights(self, ids: DataFrame, words: list[str]) -> DataFrame:
        """source_id and highlight for the ids of a page (source_id; a page is small), in one pass over the table."""
        page = self.table.select(self.id.cast("string").alias("source_id"), self.text.alias("text")).join(F.broadcast(ids.select("source_id")), "source_id", "left_semi")
        return page.select("source_id", headline(F.col("text"), words).alias("highlight"))
