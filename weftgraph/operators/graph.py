"""Graph algorithms as rounds of joins. Every round's result goes to the shared folder, so plans stay short and lost
executors cost one round; nothing of the graph is collected but for algorithms on graphs of a checked size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import hub_score
from ..schema import RANKED_LABELS
from ..work import stored

#: Edges up to which the order-dependent community search runs in one task; above it labels spread in parallel.
COMMUNITY_EDGES = 200_000
#: Rounds of ranking that run as one job; edges and vertices up to which all rounds run in one task, with the same sums.
STRETCH, RANK_EDGES = 5, 1_000_000
#: Vertices above which betweenness is 0, and up to which every vertex is a pivot.
BETWEENNESS_MOST, BETWEENNESS_EXACT, PIVOTS = 200_000, 1500, 128


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int, backwards: bool = False) -> DataFrame:
    """(entry, id, depth, parent) of all vertices within `depth` steps of each seed (column id), the seed at depth 0.

    Many entries spread at once; the parent is the smallest one on a shortest way.
    """
    near, far = ("dst", "src") if backwards else ("src", "dst")
    steps = edges.select(F.col(near).alias("at"), F.col(far).alias("to")).where("at <> to").distinct()
    steps = stored(spark, steps, "steps")
    front = stored(spark, seeds.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct(), "front")
    seen = front
    for level in range(1, depth + 1):
        found = front.join(steps, front["id"] == steps["at"]).groupBy("entry", F.col("to").alias("id")).agg(F.min("at").alias("parent"))
        fresh = found.join(seen.select("entry", "id"), ["entry", "id"], "left_anti").select("entry", "id", F.lit(level).alias("depth"), "parent")
        front = stored(spark, fresh, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def blast_radius(spark: SparkSession, edges: DataFrame, target: str, depth: int = 5, relations: tuple[str, ...] = ()) -> DataFrame:
    """(id, depth) of everything that leads to the target within `depth` steps, over all relations unless some are given."""
    own = edges.where(F.col("relation").isin(*relations)) if relations else edges
    return reach(spark, own, _one(spark, target), depth, backwards=True).where("depth > 0").select("id", "depth")


def flow_from(spark: SparkSession, edges: DataFrame, start: str, depth: int = 6) -> DataFrame:
    return reach(spark, edges.where("relation = 'Calls'"), _one(spark, start), depth).where("depth > 0").select("id", "depth")


def _one(spark: SparkSession, id_: str) -> DataFrame:
    return spark.range(1).select(F.lit(id_).alias("id"))


def shortest_path(spark: SparkSession, edges: DataFrame, start: str, end: str, most: int = 64) -> DataFrame:
    """(step, id) of a shortest way, by smallest parent among equals; empty without one of `most` steps or fewer."""
    near = edges.select("src", "dst")
    steps = stored(spark, near.where("src <> dst").distinct(), "steps")
    front = stored(spark, _one(spark, start).withColumn("parent", F.lit(None).cast("string")), "front")
    levels, seen = [front], front
    for _ in range(most):
        if not front.where(F.col("id") == end).isEmpty():
            break
        found = front.join(steps, front["id"] == steps["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = stored(spark, found.join(seen.select("id"), "id", "left_anti"), "front")
        if front.isEmpty():
            return spark.createDataFrame([], "step int, id string")
        levels.append(front)
        seen = seen.unionByName(front)
    else:
        return spark.createDataFrame([], "step int, id string")
    way, at = [], end
    for step in range(len(levels) - 1, -1, -1):  # one row for each step of the way
        way.append((step, at))
        at = levels[step].where(F.col("id") == at).select("parent").first()[0]
    return spark.createDataFrame(sorted(way), "step int, id string")


def pagerank(spark: SparkSession, vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, seeds: dict[str, float] | None = None) -> DataFrame:
    """(id, rank) after fixed rounds. Parallel edges count each; vertices without out-edges spread their mass as the teleport is.

    seeds: teleport weights that sum to 1; all vertices alike without any. The rounds are linear in the teleport vector
    t: with y(i) = (damping A)**i t, ranks are sums of the y(i) whose factors follow from the mass that each y(i) has
    on vertices without out-edges. So no round waits for a sum, a round is one shuffle (by target, which is also how
    the vertices and shares lie), and STRETCH rounds make one job. A graph of a checked size is ranked in one task.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    weights = [F.when(F.col("id") == k, v) for k, v in (seeds or {}).items()]
    teleport = F.coalesce(*weights, F.lit(0.0)) if weights else F.lit(1.0 / n)
    known = edges.select("src", "dst").join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = stored(spark, known.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), "ends")
    out = ends.groupBy("src").agg(F.sum("m").alias("total"))
    if n + ends.count() <= RANK_EDGES:
        both = ends.unionByName(vertices.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), teleport.alias("m")), allowMissingColumns=True)
        return both.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda frame: _ranked(frame, damping, rounds), "id string, rank double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = stored(spark, ends.join(out, "src").select("src", "dst", (F.col("m") / F.col("total")).alias("share")), "shares").repartition(parts, "src").persist()
    base = vertices.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("leads")), "id", "left")
    state = stored(spark, base.select("id", "leads", F.array(teleport).alias("ys")), "ranks")
    for start in range(0, rounds, STRETCH):
        state = state.repartition(parts, "id").persist()
        held = [state]
        for _ in range(start, min(rounds, start + STRETCH)):
            given = state.select("id", F.element_at("ys", -1).alias("y")).where("y > 0")
            gained = given.join(shares, given["id"] == shares["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("y") * F.col("share")).alias("g"))
            state = state.join(gained, "id", "left").select("id", "leads", F.concat("ys", F.array(damping * F.coalesce("g", F.lit(0.0)))).alias("ys")).persist()
            held.append(state)
        state = stored(spark, state, "ranks")
        for frame in held:
            frame.unpersist()
    shares.unpersist()
    loose = list(state.where("leads IS NULL").agg(*(F.coalesce(F.sum(F.col("ys")[i]), F.lit(0.0)) for i in range(rounds + 1))).first())
    factors: list[float] = []
    for turn in range(rounds):
        mass = loose[turn] + sum(f * loose[turn - 1 - j] for j, f in enumerate(factors))
        factors.append(1 - damping + damping * mass)
    share = F.array(*(F.lit(float(x)) for x in [*reversed(factors), 1.0]))
    return state.select("id", F.aggregate(F.zip_with("ys", share, lambda y, f: y * f), F.lit(0.0), lambda a, x: a + x).alias("rank"))


def _ranked(frame: pd.DataFrame, damping: float, rounds: int) -> pd.DataFrame:
    """Ranks of one task's graph: rows with a target are edges with their number, those without are vertices with their teleport."""
    own = frame["dst"].isna().to_numpy()
    ids = np.sort(frame.loc[own, "src"].to_numpy(str))
    teleport = np.zeros(len(ids))
    teleport[np.searchsorted(ids, frame.loc[own, "src"].to_numpy(str))] = frame.loc[own, "m"]
    src, dst = (np.searchsorted(ids, frame.loc[~own, c].to_numpy(str)) for c in ("src", "dst"))
    many = frame.loc[~own, "m"].to_numpy(float)
    out = np.bincount(src, many, len(ids))
    share = many / out[src]
    rank = teleport
    for _ in range(rounds):
        rank = (1 - damping + damping * rank[out == 0].sum()) * teleport + damping * np.bincount(dst, rank[src] * share, len(ids))
    return pd.DataFrame({"id": ids.astype(object), "rank": rank})


def personalized_pagerank(spark: SparkSession, vertices: DataFrame, edges: DataFrame, seeds: list[str], damping: float = 0.6, rounds: int = 50) -> DataFrame:
    """Teleports to the seeds; a repeated seed keeps its repeated weight. Without seeds to all vertices."""
    weights: dict[str, float] = {}
    for seed in seeds:
        weights[seed] = weights.get(seed, 0.0) + 1 / len(seeds)
    return pagerank(spark, vertices, edges, damping, rounds, weights or None)


def important(nodes: DataFrame, ranks: DataFrame, fans: DataFrame, k: int = 15) -> DataFrame:
    """Ranked labels by hub score, ties by id."""
    joined = nodes.where(F.col("label").isin(*RANKED_LABELS)).join(ranks, "id", "left").join(fans, "id", "left")
    joined = joined.fillna({"rank": 0.0, "fan_in": 0, "fan_out": 0})
    return joined.withColumn("score", hub_score("rank", "fan_in", "fan_out")).orderBy(F.desc("score"), "id").limit(k)


def entry_points(nodes: DataFrame, fans: DataFrame, handlers: DataFrame) -> DataFrame:
    """(id, kind): route handlers (column id), functions named main, and tasks: never called, calling three or more."""
    own = nodes.where("label IN ('Function', 'Method')").select("id", "name")
    first = handlers.select("id").distinct().withColumn("h", F.lit(1))
    joined = own.join(first, "id", "left").join(fans, "id", "left").fillna({"fan_in": 0, "fan_out": 0})
    kind = F.when(F.col("h") == 1, "route").when(F.col("name") == "main", "main").when((F.col("fan_in") == 0) & (F.col("fan_out") >= 3), "task")
    return joined.select("id", kind.alias("kind")).where("kind IS NOT NULL")


def flows(spark: SparkSession, edges: DataFrame, entries: DataFrame, ranks: DataFrame, depth: int = 6) -> DataFrame:
    """(entry, size, criticality): rank of everything an entry calls, times ln(1 + size); all entries in one run."""
    body = reach(spark, edges.where("relation = 'Calls'"), entries, depth).where("depth > 0")
    summed = body.join(ranks, "id").groupBy("entry").agg(F.count(F.lit(1)).alias("size"), F.sum("rank").alias("total"))
    return summed.select("entry", "size", (F.col("total") * F.log1p(F.col("size").cast("double"))).alias("criticality"))


def _louvain(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """One level of local moving over an undirected multigraph; vertices and ties in index order."""
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b in pairs:
        around[a][b] = around[a].get(b, 0) + 1
        around[b][a] = around[b].get(a, 0) + 1
    degree = [sum(x.values()) for x in around]
    total = sum(degree)
    home = list(range(n))
    weight = degree[:]
    if not total:
        return home
    for _ in range(20):
        moved = False
        for v in range(n):
            if not around[v]:
                continue
            links = {home[v]: 0}
            for u, w in around[v].items():
                links[home[u]] = links.get(home[u], 0) + w
            weight[home[v]] -= degree[v]
            gains = {c: w - degree[v] * weight[c] / total for c, w in links.items()}
            top = max(gains.values())
            best = min(c for c, gain in gains.items() if top - gain <= 1e-12)  # equal gains: the smaller community
            weight[best] += degree[v]
            moved |= best != home[v]
            home[v] = best
        if not moved:
            break
    number: dict[int, int] = {}
    return [number.setdefault(c, len(number)) for c in home]


def communities(spark: SparkSession, vertices: DataFrame, edges: DataFrame, most_edges: int = COMMUNITY_EDGES, rounds: int = 20) -> tuple[DataFrame, str]:
    """((id, community), evidence quality): exact order-dependent search on graphs of a checked size, else approximate labels."""
    own = edges.select("src", "dst")
    if own.limit(most_edges + 1).count() + vertices.limit(most_edges + 1).count() <= most_edges:

        def solve(frames: pd.DataFrame) -> pd.DataFrame:
            ids = sorted(frames.loc[frames["dst"].isna(), "src"])
            at = {v: i for i, v in enumerate(ids)}
            pairs = [(at[a], at[b]) for a, b in zip(frames["src"], frames["dst"]) if isinstance(b, str) and a in at and b in at]
            return pd.DataFrame({"id": ids, "community": _louvain(len(ids), sorted(pairs))})

        both = own.unionByName(vertices.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")))
        return both.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, "id string, community long"), "Exact"
    both = stored(spark, own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "links")
    labels = stored(spark, vertices.select("id", F.xxhash64("id").alias("community")), "labels")
    for _ in range(rounds):
        heard = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "community").agg(F.sum("w").alias("w"))
        chosen = heard.groupBy("src").agg(F.max_by("community", F.struct("w", "community")).alias("new"))
        moved = labels.join(chosen, labels["id"] == chosen["src"], "left").select("id", F.coalesce("new", "community").alias("next"), "community")
        moved = stored(spark, moved, "labels")
        changed = moved.where("next <> community").limit(1).count()
        labels = moved.select("id", F.col("next").alias("community"))
        if not changed:
            break
    return labels, "Approximate"


def betweenness(spark: SparkSession, vertices: DataFrame, edges: DataFrame, most: int = BETWEENNESS_MOST) -> DataFrame:
    """(id, betweenness): directed, unnormalised, parallel edges as ways of their own; pivots are dealt to tasks.

    The adjacency is broadcast for graphs of at most `most` vertices and 20 times as many edges; beyond, all are 0.
    """
    n = vertices.limit(most + 1).count()
    if not n or n > most or edges.limit(20 * most + 1).count() > 20 * most:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    ids = [r[0] for r in vertices.select("id").orderBy("id").collect()]
    at = {v: i for i, v in enumerate(ids)}
    ends = np.array([(at[a], at[b]) for a, b in edges.select("src", "dst").collect() if a in at and b in at], np.int64).reshape(-1, 2)
    ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
    shared = spark.sparkContext.broadcast((np.searchsorted(ends[:, 0], np.arange(n + 1)), ends[:, 1]))
    pivots = list(range(n)) if n <= BETWEENNESS_EXACT else list(range(0, n, n // PIVOTS))

    def run(frames):
        first, to = shared.value
        total = np.zeros(n)
        for frame in frames:
            for s in frame["pivot"]:
                distance, ways, back = {s: 0}, {s: 1.0}, []
                level = [s]
                while level:
                    back.append(level)
                    following = []
                    for v in level:
                        for u in to[first[v] : first[v + 1]].tolist():
                            if u not in distance:
                                distance[u], ways[u] = distance[v] + 1, 0.0
                                following.append(u)
                            if distance[u] == distance[v] + 1:
                                ways[u] += ways[v]
                    level = following
                depend = dict.fromkeys(distance, 0.0)
                for level in reversed(back):
                    for v in level:
                        for u in to[first[v] : first[v + 1]].tolist():
                            if distance[u] == distance[v] + 1:
                                depend[v] += ways[v] / ways[u] * (1 + depend[u])
                        if v != s:
                            total[v] += depend[v]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"i": some, "b": total[some]})

    parts = min(len(pivots), spark.sparkContext.defaultParallelism)
    sums = spark.createDataFrame([(p,) for p in pivots], "pivot long").repartition(parts).mapInPandas(run, "i long, b double").groupBy("i").agg(F.sum("b").alias("b"))
    named = spark.createDataFrame(list(enumerate(ids)), "i long, id string")
    return named.join(sums, "i", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def analyse(spark: SparkSession, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community, pagerank, betweenness) of every vertex."""
    groups, _ = communities(spark, vertices, edges)
    ranks = pagerank(spark, vertices, edges).withColumnRenamed("rank", "pagerank")
    return vertices.select("id").join(groups, "id", "left").join(ranks, "id", "left").join(betweenness(spark, vertices, edges), "id", "left")


def layout(ids: list[str], pairs: list[tuple[str, str]], rounds: int = 260) -> dict[str, tuple[float, float]]:
    """Plane positions of a graph cut to a picture's size: a golden-angle start, springs and repulsion. Presentation only."""
    n = len(ids)
    at = {v: i for i, v in enumerate(ids)}
    angle = np.arange(n) * np.pi * (3 - 5**0.5)
    place = np.stack([np.cos(angle), np.sin(angle)], 1) * np.sqrt(np.arange(n) + 1)[:, None]
    ends = np.array([(at[a], at[b]) for a, b in pairs if a in at and b in at], np.int64).reshape(-1, 2)
    for turn in range(rounds):
        away = place[:, None] - place[None]
        force = (away / (np.square(away).sum(2)[:, :, None] + 0.01)).sum(1)
        pull = (place[ends[:, 1]] - place[ends[:, 0]]) * 0.05
        np.add.at(force, ends[:, 0], pull)
        np.add.at(force, ends[:, 1], -pull)
        place = place + np.clip(force, -1, 1) * (1 - turn / rounds)
    return {v: (float(x), float(y)) for v, (x, y) in zip(ids, place)}
