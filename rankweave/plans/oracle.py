"""SQL for the catalogue's queries, built from named table expressions."""

from __future__ import annotations

from ..functions.text import query_lexemes

#: The tables to look through: source_id, text and what predicates use.
TABLES = {
    "documents": "SELECT CAST(d.doc_id AS VARCHAR) AS source_id, d.text, d.lang, d.source, epoch_us(e.ts) // 1000 AS ts_ms FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id",
    "conversations": "SELECT conv_id || ':' || turn AS source_id, text, role, conv_id FROM conversations",
    "pages": "SELECT CAST(page_id AS VARCHAR) AS source_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages",
}


class Sql:
    def __init__(self) -> None:
        self.parts: list[tuple[str, str]] = [("docs_all", TABLES["documents"])]
        self.terms: dict[str, list[str]] = {}
        self.lists: list[str] = []

    def add(self, name: str, body: str) -> Sql:
        self.parts.append((name, body))
        return self

    def lexical(self, text: str, table: str = "documents", pre: str = "", where: str = "true") -> Sql:
        """Matched postings, document coverage and cover-density scores of a query's terms."""
        terms = self.terms[pre] = query_lexemes(text)
        quoted = ", ".join(f"'{t}'" for t in terms)
        words = f"SELECT source_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({TABLES[table]}) WHERE {where}"
        self.add(f"{pre}hit", f"SELECT * FROM (SELECT source_id, unnest(range(len(w))) AS word, unnest(w) AS lex FROM ({words})) WHERE lex IN ({quoted})")
        last = ", ".join(f"max(CASE WHEN lex = '{t}' THEN word END) OVER w AS l{i}" for i, t in enumerate(terms))
        self.add(f"{pre}lasts", f"SELECT source_id, word, {last} FROM {pre}hit WINDOW w AS (PARTITION BY source_id ORDER BY word ROWS UNBOUNDED PRECEDING)")
        self.add(f"{pre}cov", f"SELECT source_id, count(DISTINCT lex) AS coverage FROM {pre}hit GROUP BY 1")
        names = [f"l{i}" for i in range(len(terms))]
        present = " + ".join(f"(CASE WHEN {n} IS NULL THEN 0 ELSE 1 END)" for n in names)
        self.add(f"{pre}spans", f"SELECT source_id, least({', '.join(names)}) AS p, min(word) AS q FROM {pre}lasts JOIN {pre}cov USING (source_id) WHERE {present} = coverage GROUP BY 1, 2")
        return self.add(f"{pre}lx", f"SELECT source_id, coverage, round(sum(CASE WHEN q - p + 1 <= 16 THEN 1e0 ELSE 16e0 / (q - p + 1) END), 6) AS score FROM {pre}spans JOIN {pre}cov USING (source_id) GROUP BY 1, 2")

    def ands(self, cap: int, pre: str = "") -> Sql:
        return self.add(f"{pre}ands", f"SELECT source_id, score, row_number() OVER (ORDER BY score DESC, source_id) AS pos FROM {pre}lx WHERE coverage = {len(self.terms[pre])} QUALIFY pos <= {cap}")

    def anchors(self, budget: int, pre: str = "") -> Sql:
        df = f"SELECT lex, count(DISTINCT source_id) AS df FROM {pre}hit GROUP BY 1"
        return self.add(f"{pre}anchors", f"SELECT lex, df FROM (SELECT lex, df, sum(df) OVER o AS total, row_number() OVER o AS nth FROM ({df}) WINDOW o AS (ORDER BY df, lex ROWS UNBOUNDED PRECEDING)) WHERE nth = 1 OR total <= {budget}")

    def graded(self, cap: int, budget: int, pre: str = "") -> Sql:
        self.anchors(budget, pre)
        least = 1 if len(self.terms[pre]) == 1 else 2
        return self.add(f"{pre}graded", f"SELECT source_id, coverage, score, row_number() OVER (ORDER BY coverage DESC, score DESC, source_id) AS pos FROM {pre}lx WHERE coverage >= {least} AND source_id IN (SELECT source_id FROM {pre}hit WHERE lex IN (SELECT lex FROM {pre}anchors)) QUALIFY pos <= {cap}")

    def cascade(self, cap: int, pre: str = "") -> Sql:
        more = f"SELECT source_id, score, (SELECT count(*) FROM {pre}ands) + row_number() OVER (ORDER BY pos) AS pos, true AS appended FROM {pre}graded WHERE source_id NOT IN (SELECT source_id FROM {pre}ands) QUALIFY pos <= {cap}"
        return self.add(f"{pre}cascaded", f"SELECT source_id, score, pos, false AS appended FROM {pre}ands UNION ALL SELECT * FROM ({more})")

    def cosine(self, vec_id: int, where: str = "true", pre: str = "") -> Sql:
        pair = f"SELECT CAST(a.vec_id AS VARCHAR) AS source_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM (SELECT * FROM embeddings WHERE {where}) a, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) b"
        return self.add(f"{pre}cosine", f"SELECT source_id, round(list_cosine_similarity(x, y), 6) AS score FROM ({pair})")

    def nearest(self, cap: int, pre: str = "") -> Sql:
        return self.add(f"{pre}near", f"SELECT source_id, score, row_number() OVER (ORDER BY score DESC, source_id) AS pos FROM {pre}cosine QUALIFY pos <= {cap}")

    def listing(self, name: str, ranker: str, input_ord: int, floor: float | None = None, query: int = 0) -> Sql:
        where = "" if floor is None else f" WHERE score >= {floor}e0"
        self.lists.append(f"SELECT {query} AS query_id, 'documents:' || source_id AS key, '{ranker}' AS ranker, {input_ord} AS input_ord, score, row_number() OVER (ORDER BY pos) AS pos FROM {name}{where}")
        return self

    def fresh(self, name: str, seats: int, main: str = "cascaded") -> Sql:
        self.lists.append(f"SELECT 0 AS query_id, 'documents:' || source_id AS key, 'lexical-fresh' AS ranker, 1 AS input_ord, score, row_number() OVER (ORDER BY pos) AS pos FROM {name} f WHERE source_id NOT IN (SELECT source_id FROM {main}) QUALIFY row_number() OVER (ORDER BY f.pos) <= {seats}")
        return self

    def fuse(self) -> Sql:
        self.add("entries", " UNION ALL ".join(f"SELECT * FROM ({x})" for x in self.lists))
        self.add("scores", "SELECT query_id, key, round(sum(1e0 / (60 + pos)), 12) AS score, min(input_ord * 1000000 + pos) AS tie, string_agg(ranker, ',' ORDER BY input_ord, pos) AS rankers, max(CASE WHEN ranker = 'lexical' THEN score END) AS lexical_score, max(CASE WHEN ranker = 'embeddings' THEN score END) AS semantic_score FROM entries GROUP BY 1, 2")
        return self.add("fused", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS pos FROM scores")

    def out(self, select: str, drop: tuple[str, ...] = ()) -> str:
        body = f"SELECT * EXCLUDE ({', '.join(drop)}) FROM ({select})" if drop else select
        return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in self.parts) + f"\n{body}"
