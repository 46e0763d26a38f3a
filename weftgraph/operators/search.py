"""Ranked text search over nodes: an inverted index with Okapi BM25, label boosts and a re-ranking of the best."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import file_stem, is_test_path, search_terms, subwords

K1, B = 1.2, 0.75
#: Weights of the indexed columns and boosts by label: fixed values of the ranking.
WEIGHTS = {"name": 10.0, "parts": 6.0, "doc_text": 1.0}
BOOSTS = {"Function": 6.0, "Method": 6.0, "Class": 5.0, "Interface": 5.0, "Enum": 4.0, "Route": 4.0, "File": 1.0}
EXACT_BOOST, TEST_PENALTY, MOST_DOCUMENTS = 8.0, 1.5, 5
TOKENS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKENS), lambda t: t != "")


def indexed(nodes: DataFrame) -> DataFrame:
    """nodes with the columns that the index reads; doc_text is the first 8000 characters of the text."""
    have = set(nodes.columns)
    out = nodes if "parts" in have else nodes.withColumn("parts", subwords("name"))
    return out if "doc_text" in have else out.withColumn("doc_text", F.substring(F.coalesce("text", F.lit("")), 1, 8000) if "text" in have else F.lit(""))


def postings(nodes: DataFrame) -> DataFrame:
    """(id, column, term, tf, size): the inverted index with the length of each indexed column."""
    own = indexed(nodes)
    columns = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("terms")) for c in WEIGHTS))).alias("x")
    listed = own.select("id", columns).select("id", "x.column", F.size("x.terms").alias("size"), F.explode("x.terms").alias("term"))
    return listed.groupBy("id", "column", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))


def bm25(nodes: DataFrame, terms: list[str], prefix: bool = False, every: bool = False) -> DataFrame:
    """(id, score) of the nodes that hold a term (all of them with `every`); with prefix a term stands for its continuations.

    Document frequencies and mean sizes come from one pass over the whole table; only rows with a term are exploded.
    """
    own = indexed(nodes)
    arrays = own.select("id", *(tokens(F.col(c)).alias(c) for c in WEIGHTS))
    match = lambda t, term: t.startswith(term) if prefix else t == term

    def count(c: str, term: str) -> Column:
        return F.size(F.filter(F.col(c), lambda t: match(t, term)))

    counted = arrays.select("id", *(F.size(c).alias(f"n_{c}") for c in WEIGHTS), *(count(c, t).alias(f"tf_{i}_{c}") for i, t in enumerate(terms) for c in WEIGHTS))
    has = lambda i: sum((F.col(f"tf_{i}_{c}") for c in WEIGHTS), F.lit(0)) > 0
    totals = counted.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"n_{c}").alias(f"avg_{c}") for c in WEIGHTS), *(F.count(F.when(has(i), 1)).alias(f"df_{i}") for i in range(len(terms)))).first()
    some = [has(i) for i in range(len(terms))]
    chosen = counted.where(_all(some) if every else _any(some))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.lit(float(totals["n"])) - totals[f"df_{i}"] + 0.5) / (totals[f"df_{i}"] + 0.5))
        for c, weight in WEIGHTS.items():
            tf = F.col(f"tf_{i}_{c}").cast("double")
            score = score + weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"n_{c}") / max(totals[f"avg_{c}"] or 0.0, 1e-9)))
    return chosen.select("id", score.alias("score"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _scored(nodes: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    boost = F.lit(0.0)
    for label, value in BOOSTS.items():
        boost = F.when(F.col("label") == label, value).otherwise(boost)
    exact = F.when(F.lower("name") == query.lower(), EXACT_BOOST).otherwise(0.0)
    penalty = F.when(is_test_path(F.coalesce("file_path", F.lit(""))), TEST_PENALTY).otherwise(0.0)
    return nodes.join(hits, "id").withColumn("score", F.col("score") + boost + exact - penalty)


def search_fts(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes with any word of the query, best first, ties by id."""
    terms = search_terms(query, least=1)
    if not terms:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    return _scored(nodes, bm25(nodes, terms), query).orderBy(F.desc("score"), "id").limit(limit)


def search_smart(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """search_fts, else all subword prefixes, else any; re-ranked by name, one row per document file, few documents beside code."""
    wide = max(3 * limit, 24)
    found = search_fts(nodes, query, wide)
    if found.isEmpty():
        import re

        parts = [p.lower() for p in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", query) if len(p) > 1][:8]
        if not parts:
            return found
        for every in (True, False):
            found = _scored(nodes, bm25(nodes, parts, prefix=True, every=every), query).orderBy(F.desc("score"), "id").limit(wide)
            if not found.isEmpty():
                break
    low = query.lower()
    text = F.lower(F.coalesce(F.col("doc_text") if "doc_text" in nodes.columns else F.lit(""), F.lit("")))
    rank = (
        F.when(F.lower("name") == low, 4).when((F.lower(file_stem("file_path")) == low) | F.contains(F.lower("name"), F.lit(low)), 3)
        .when(F.col("label") != "Document", 2).when(F.contains(text, F.lit(low)), 1).otherwise(0)
    )
    # All of this is about `wide` rows.
    own = found.withColumn("bonus", rank)
    group = F.when(F.col("label") == "Document", F.concat(F.lit("d:"), "file_path")).otherwise(F.concat(F.lit("c:"), "id"))
    best = own.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("bonus"), F.desc("score"), "id"))).where("place = 1")
    is_document = F.col("label") == "Document"
    numbered = best.withColumn("nth", F.row_number().over(W.partitionBy(is_document).orderBy(F.desc("bonus"), F.desc("score"), "id")))
    code = not best.where(~is_document).isEmpty()
    kept = numbered.where(~is_document | (F.col("nth") <= MOST_DOCUMENTS)) if code else numbered
    return kept.orderBy(F.desc("bonus"), F.desc("score"), "id").limit(limit).drop("place", "nth")


def search_regex(nodes: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    return nodes.where(F.col("name").rlike(pattern)).orderBy("id").limit(limit)


def reranked(rows: list, order: Callable[[list], str] | None = None) -> list:
    """rows in the order of a model's comma-separated list of places from 1; any failure keeps the order."""
    if order is None:
        return rows
    try:
        picked = list(dict.fromkeys(int(x) - 1 for x in order(rows).split(",")))
        chosen = [rows[i] for i in picked if 0 <= i < len(rows)]
        return chosen + [r for i, r in enumerate(rows) if i not in picked]
    except Exception:
        return rows
