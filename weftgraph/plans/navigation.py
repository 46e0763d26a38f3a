"""Questions about a stored graph: each answer is a DataFrame with what is known about its completeness."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import display_label, search_terms
from ..operators import coverage, graph, lookups, search, services, vectors
from ..schema import CALLABLE_LABELS, SYMBOL_LABELS
from ..store import GraphStore
from . import cypher


@dataclass
class Answer:
    """Rows with generation, freshness, evidence quality and coverage, which do not depend on each other."""

    data: DataFrame
    generation: int
    freshness: str = "Unknown"
    evidence: str = "Exact"
    coverage: DataFrame | None = None
    notes: dict = field(default_factory=dict)


class Navigator:
    """Tables are read once for each generation; a new one is picked up by refresh()."""

    def __init__(self, store: GraphStore, embedder: vectors.Embedder | None = None, reranker=None, model: str | None = None, listing=None):
        """model: the name of the embedder's model, which has to be that of the stored vectors. listing: a callable that
        gives the files as they are (file_path, mtime), to tell whether answers are fresh."""
        self.store, self.embedder, self.reranker, self.model, self.listing = store, embedder, reranker, model, listing
        self.refresh()

    def refresh(self) -> None:
        self.store._state = self.store._load()
        self.tables = {name: self.store.table(name) for name in ("nodes", "edges", "calls", "symbol_refs", "inherits", "fields", "imports", "locals", "type_refs", "cochanges", "manifest", "vectors")}
        calls = self.tables["calls"]
        self.calls = calls.withColumn("receiver_name", F.col("receiver.name"))
        self.freshness = "Unknown"
        if self.listing is not None:
            self.freshness = "Fresh" if services.staleness(self.listing(), self.tables["manifest"]).isEmpty() else "Stale"

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def _answer(self, data: DataFrame, **more) -> Answer:
        return Answer(data, self.store.generation, **{"freshness": self.freshness, **more})

    def search(self, query: str, limit: int = 20, regex: bool = False) -> Answer:
        own = self.nodes.drop("doc_text", "parts").withColumn("text", F.try_element_at("metadata", F.lit("text")))
        hits = search.search_regex(own, query, limit) if regex else search.search_smart(own, query, limit)
        fields = lookups.field_matches(self.fields, self.locals, query)
        return self._answer(hits, notes={"fields": fields})

    def node(self, id_: str, files: DataFrame | None = None) -> Answer:
        own = self.nodes.where(F.col("id") == id_)
        if files is not None:
            from ..sources.files import snippets

            own = own.join(snippets(files, own), "id", "left")
        return self._answer(own)

    def callers(self, name: str | None = None, id_: str | None = None) -> Answer:
        """Callers of one node; of a name with several definitions the candidates, those with most resolved callers first."""
        if id_ is not None:
            return self._answer(lookups.callers_of_id(self.nodes, self.edges, id_))
        definitions = lookups.definitions_of(self.nodes, self.edges, name)
        if definitions.limit(2).count() > 1:
            return self._answer(definitions.orderBy(F.desc("resolved_callers"), "file_path", "id"), evidence="Unavailable", notes={"candidates": True})
        textual = coverage.unresolved_site_files(self.nodes, self.calls, self.imports, name)
        usages = coverage.type_usages(name, self.calls, self.symbol_refs, self.inherits, self.fields, self.locals, self.imports, self.type_refs).orderBy("file_path").limit(50)
        covered = coverage.coverage_for_callers(self.nodes, self.edges, self.calls, self.imports, name)
        return self._answer(lookups.callers_of(self.nodes, self.edges, name), evidence="LowerBound", coverage=covered, notes={"textual": textual, "usages": usages})

    def callees(self, id_: str) -> Answer:
        loose = coverage.unresolved_callee_names(self.nodes, self.edges, self.calls.where(F.col("caller_id") == id_), self.imports).orderBy("callee_name").limit(30)
        covered = coverage.coverage_for_callees(self.nodes, self.edges, self.calls, self.imports, id_)
        return self._answer(lookups.callees_of(self.nodes, self.edges, id_), evidence="LowerBound", coverage=covered, notes={"unresolved": loose})

    def _first(self, name: str) -> str | None:
        found = self.nodes.where(F.col("name") == name).agg(F.min("id")).first()[0]
        return found

    def path(self, start: str, end: str) -> Answer:
        a, b = self._first(start), self._first(end)
        empty = self.store.spark.createDataFrame([], "step int, id string")
        return self._answer(empty if a is None or b is None else graph.shortest_path(self.store.spark, self.edges, a, b))

    def impact(self, name: str, depth: int = 5, limit: int = 200) -> Answer:
        target = self._first(name)
        if target is None:
            return self._answer(self.nodes.limit(0))
        reached = graph.blast_radius(self.store.spark, self.edges, target, depth)
        covered = coverage.coverage_for_callers(self.nodes, self.edges, self.calls, self.imports, name)
        return self._answer(reached.join(self.nodes, "id").orderBy("depth", "id").limit(limit), evidence="LowerBound", coverage=covered, notes={"total": reached.count()})

    def context(self, query: str, budget: int = 2000, seeds: int = 12, code_only: bool = False) -> Answer:
        """Symbols near the query by personalized rank, until their labels fill the budget (a quarter of their length, and 4)."""
        own = self.nodes.withColumn("text", F.try_element_at("metadata", F.lit("text"))).drop("doc_text", "parts")
        terms = search_terms(query, least=2) or [query]
        found = search.search_fts(own, " ".join(terms), seeds)
        found = found.where(F.col("label").isin(*SYMBOL_LABELS)) if code_only else found
        ids = [r[0] for r in found.select("id").collect()]
        ranks = graph.personalized_pagerank(self.store.spark, self.nodes.select("id"), self.edges, ids)
        top = ranks.orderBy(F.desc("rank"), "id").limit(200).join(self.nodes, "id").where(F.col("label") != "File")
        text = top.withColumn("shown", display_label("id", "name", "file_path", "line_start"))
        cost = F.floor(F.length("shown") / 4) + 4
        # At most 200 rows.
        running = text.withColumn("used", F.sum(cost).over(W.orderBy(F.desc("rank"), "id")))
        return self._answer(running.where(F.col("used") <= budget).select("id", "shown", "rank"), evidence="Approximate")

    def important(self, k: int = 15) -> Answer:
        return self._answer(graph.important(self.nodes.drop("fan_in", "fan_out"), self.nodes.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("rank")), lookups.degrees(self.edges), k))

    def communities(self, sample: int = 8) -> Answer:
        own = self.nodes.where("label <> 'File' AND community IS NOT NULL")
        sizes = own.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
        ranked = own.withColumn("place", F.row_number().over(W.partitionBy("community").orderBy("name", "id"))).where(F.col("place") <= sample)
        names = ranked.groupBy("community").agg(F.array_sort(F.collect_set("name")).alias("names"))
        return self._answer(sizes.join(names, "community").join(lookups.dominant_directory(own), "community").orderBy(F.desc("size"), "community"))

    def architecture(self) -> dict[str, DataFrame]:
        own = self.nodes.where("label <> 'File' AND community IS NOT NULL")
        key = own.withColumn("degree", F.coalesce("fan_in", F.lit(0)) + F.coalesce("fan_out", F.lit(0)))
        key = key.withColumn("place", F.row_number().over(W.partitionBy("community").orderBy((F.col("degree") == 0).cast("int"), F.desc("pagerank"), "id"))).where("place <= 3")
        return {
            "labels": lookups.counts_by(self.nodes, "label"), "languages": lookups.counts_by(self.nodes, "language"), "communities": self.communities().data.limit(8),
            "key_symbols": key.select("community", "id", "name"), "routes": self.nodes.where("label = 'Route'").agg(F.count(F.lit(1)).alias("n")),
        }

    def stats(self) -> dict:
        audited = self.store.meta("audit_generation")
        return {"generation": self.store.generation, "nodes": self.nodes.count(), "edges": self.edges.count(), "embedder": self.embedder is not None, "audit_stale": audited is not None and int(audited) < self.store.generation}

    def handlers(self) -> DataFrame:
        return self.nodes.where("label = 'Route'").select(F.try_element_at("metadata", F.lit("handler")).alias("id")).where("id IS NOT NULL")

    def dead_code(self, limit: int = 100) -> Answer:
        found = services.dead_code_assessed(self.nodes, self.edges, self.calls, self.symbol_refs, self.handlers())
        return self._answer(found.where("verdict = 'candidate'").orderBy("file_path", "line_start", "id").limit(limit), evidence="LowerBound")

    def co_changes(self, file_path: str, k: int = 10) -> Answer:
        return self._answer(lookups.cochanges_for(self.cochanges, file_path).limit(k))

    def review(self, changed: DataFrame, base: DataFrame, renames: DataFrame, limit: int = 40) -> Answer:
        rows = services.review_rows(self.nodes, self.edges, self.calls, changed).limit(limit)
        unknown = coverage.file_coverage(changed.select("file_path").distinct(), self.nodes, self.manifest).where("coverage = 'NotIndexed'")
        return self._answer(rows, notes={"lost": services.vanished_symbols(base, self.nodes, renames, changed), "unknown": unknown, "hints": services.review_hints(self.cochanges, changed)})

    def graph_query(self, text: str) -> Answer:
        rows = cypher.run(text, self.nodes, self.edges)
        return self._answer(rows, notes={"limit": cypher.parse(text).limit})

    def flows(self, k: int = 10, depth: int = 6) -> Answer:
        entries = graph.entry_points(self.nodes.drop("fan_in", "fan_out"), lookups.degrees(self.edges), self.handlers())
        ranks = self.nodes.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("rank"))
        found = graph.flows(self.store.spark, self.edges, entries, ranks, depth)
        return self._answer(found.join(entries, found["entry"] == entries["id"]).drop("id").orderBy(F.desc("criticality"), "entry").limit(k))

    def implementers(self, name: str) -> Answer:
        return self._answer(lookups.implementers_of(self.nodes, self.edges, name))

    def routes(self, prefix: str = "", method: str = "", offset: int = 0, limit: int = 100) -> Answer:
        return self._answer(lookups.routes(self.nodes, prefix, method, offset, limit), notes={"total": self.nodes.where("label = 'Route'").count()})

    def semantic(self, query: str, k: int = 15) -> Answer:
        own = self.nodes.withColumn("text", F.try_element_at("metadata", F.lit("text"))).drop("doc_text", "parts")
        hits, degraded = vectors.semantic_search(own, self.vectors, query, k, self.embedder, self.store.meta("embed_model"), self.model)
        return self._answer(hits, evidence="Approximate", notes={"degraded": degraded})

    def report(self) -> dict[str, DataFrame]:
        """The sections of the overview, each a small frame in a fixed order."""
        calls = self.edges.where("relation = 'Calls'")
        hot = self.nodes.where(F.col("label").isin(*CALLABLE_LABELS)).join(coverage.test_evidence(self.nodes, self.edges, self.calls), "id")
        value = services.risk(F.coalesce("fan_in", F.lit(0)), F.coalesce("complexity", F.lit(1)), F.col("evidence"))
        return {
            "overview": lookups.counts_by(self.nodes, "label").orderBy("label"), "resolution": lookups.edges_by_justification(calls).orderBy("justification"),
            "central": self.important(15).data, "hotspots": hot.withColumn("risk", value).orderBy(F.desc("risk"), "id").limit(10), "communities": self.communities().data.limit(8),
            "flows": self.flows(10).data, "routes": self.routes(limit=20).data, "dead": self.dead_code(10).data, "cochanges": self.cochanges.orderBy(F.desc("n"), "file_a", "file_b").limit(10),
            "health": lookups.violations(self.nodes, self.edges),
        }
