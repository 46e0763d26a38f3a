"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

1. Each text becomes the set of its distinct shingles. One hash of each shingle picks a bin (its top bits) and competes
   there by its value; empty bins borrow from a bin that a fixed random sequence leads to (optimal densification).
2. Equal sets are grouped first: a set is one node, whatever the keys of its rows, and the keys only name the result.
3. Bands of the signature are bucket keys. In every bucket one member, that which meets most others in its buckets, is
   the centre of a star: pairs are bounded by the number of members. Pairs are confirmed on the full shingle sets;
   the members of a large star are dealt out, each part with a copy of the centre's text.
4. A link between two members that are not both linked to their centre c needs shared differences from c: with d
   shingles of c missing and a others added, W = 100 d + p a for a threshold of p percent, and s shared differences,
   x and y are linked exactly if (100 + p) s >= W(x) + W(y) - (100 - p) |c|, where W(x) > (100 - p) |c| for an x
   that is not linked to c. So y shares (W(y) + 1) / (100 + p) of its differences at least, and one of its first ones
   (prefix filter, the rarest differences of the star first) is among those of x, with enough of both lists behind it
   (position filter). Pairs that meet there are confirmed by their full lists of differences, which is the threshold on
   the full sets: no link inside a bucket is lost, and copies that differ in places of their own make no pairs. Clusters
   beside the centre are first gathered around second centres of their own, and only members of different components
   are then brought together, so a cluster does not make pairs of all its members.
5. Confirmed links make components (large-star, small-star).

With 32 bands of 4 rows a pair at similarity 0.85 shares no bucket with probability 5e-11, at 0.8 with 5e-8.

Nulls: a null text, or one without words, has an empty set and is linked with nothing. Fewer words than a shingle has
make one shingle of all of them. Repeated rows are equal sets. A row with a null key takes part: it is kept only if no row
of its component has a key, whose component_id is null then. Rows that share a key but not the text may lie in different
components. Tables may be empty; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

BINS, ROWS = 128, 4
#: Members of a star that are compared in one task, and second centres that each star gets.
CHUNK, ROUNDS = 256, 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    data = common.lowered(data)
    starts, stops, firsts = common.words(data, offsets, common.NON_SPACE)
    hashes = common.span_hash(common.prefix_hash(data), starts, stops)
    counts = np.diff(firsts)
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    at = np.arange(len(hashes)) - firsts[:-1][text]
    value = np.full(len(hashes), np.uint64(size))
    factor = np.uint64(common.BASE)
    short = counts < size
    whole = np.flatnonzero((at + size <= counts[text]) & ~short[text])
    out = value[whole]
    for k in range(size):
        out = common.mix(out * factor + hashes[whole + k])
    texts, values = [text[whole]], [out]
    for k in range(1, size):  # texts of k words: one shingle
        own = np.flatnonzero((at == 0) & (counts[text] == k))
        if len(own):
            out = np.full(len(own), np.uint64(k))
            for j in range(k):
                out = common.mix(out * factor + hashes[own + j])
            texts.append(text[own])
            values.append(out)
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _borrowing(bins: int, attempts: int) -> np.ndarray:
    """For each attempt and bin, the bin to borrow from: the same for all texts."""
    at = np.arange(attempts * bins, dtype=np.uint64) + np.uint64(1)
    return (common.mix(at * np.uint64(common.BASE)) % np.uint64(bins)).astype(np.int64).reshape(attempts, bins)


BORROW = _borrowing(BINS, 4096)


def signatures(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """n signatures of BINS values; texts without shingles get all ones."""
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    slot = text * BINS + (value >> shift).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]  # values are sorted, so the first of a bin is its least
    out = np.full(n * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(n * BINS, bool)
    out[slot[first]] = value[first]
    filled[slot[first]] = True
    some = filled.reshape(n, BINS).any(1)
    empty = np.flatnonzero(~filled & np.repeat(some, BINS))
    for bins in BORROW:
        if not len(empty):
            break
        source = empty - empty % BINS + bins[empty % BINS]
        good = filled[source]
        out[empty[good]] = out[source[good]]
        empty = empty[~good]
    if len(empty):  # as good as never: the next filled bin
        grid = filled.reshape(n, BINS)
        for e in empty.tolist():
            row, bin_ = divmod(e, BINS)
            out[e] = out[row * BINS + next((bin_ + k) % BINS for k in range(1, BINS) if grid[row, (bin_ + k) % BINS])]
    return out.reshape(n, BINS)


def sketched(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the row's own pair of longs (at, of), n_shingles, the set's 128-bit digest (two longs) and band keys."""
    bands = BINS // ROWS
    schema = "doc_id long, at long, of long, n_shingles long, set_a long, set_b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            data, offsets = common.utf8(block.column("text"))
            n = len(offsets) - 1
            text, value = shingle_sets(data, offsets, size)
            counts = np.bincount(text, minlength=n)
            # The shingles are distinct, so the sums of two mixes of their hashes describe the set.
            ends = np.cumsum(counts)
            digests = []
            for salt in (common.BASE, 0xC2B2AE3D27D4EB4F):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(value ^ np.uint64(salt)), dtype=np.uint64)])
                digests.append(sums[ends] - sums[ends - counts])
            signed = signatures(text, value, n)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)) * np.uint64(common.BASE)
            for r in range(ROWS):
                keys = common.mix(keys * np.uint64(common.BASE) + signed[:, r::ROWS])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            own = [block.column(c) for c in ("doc_id", "at", "of")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), *(pa.array(d.view(np.int64)) for d in digests), lists], names=["doc_id", "at", "of", "n_shingles", "set_a", "set_b", "bands"])

    return _texts(docs, key, text).mapInArrow(run, schema)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    at, of = common.row_key(F.col(key), F.col(text).cast("string"))
    return docs.select(F.col(key).cast("long").alias("doc_id"), at.alias("at"), of.alias("of"), F.col(text).cast("string").alias("text"))


def _sets_of(batch: pa.RecordBatch, name: str, size: int) -> list[np.ndarray]:
    data, offsets = common.utf8(batch.column(name))
    text, value = shingle_sets(data, offsets, size)
    return np.split(value, np.searchsorted(text, np.arange(1, len(offsets) - 1)))


def _around(stars: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (a, b, text) of the stars' members, b, and before them, with b null, their centre's: once for every CHUNK
    members, so that a large star is dealt out over many tasks and its centre's text is not copied to each member."""
    parts = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    members = stars.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    texts = own.hint("merge")
    members = members.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    centres = parts.join(texts.withColumnRenamed("node", "a"), "a")
    centres = centres.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    return members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text")


def _compared(around: DataFrame, size: int, percent: int) -> DataFrame:
    """Members (b) against their centre (a): whether they are linked, the shingles that were added and those that are
    missing (as complements, which keeps the two kinds apart), and how many of these differences, in any order that all
    members share, another member has to be looked up by (index) or, for a member that is not linked, to look up (probe)."""
    names = ["a", "b", "linked", "added", "missing", "index", "probe", "weight", "excess"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(0, np.uint64)
        for batch in common.blocks(batches, "text", common.BLOCK_BYTES // 2):
            rows = []
            for a, b, x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _sets_of(batch, "text", size)):
                if b is None:
                    c = x
                    continue
                added, missing = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                n, weight = len(added) + len(missing), 100 * len(missing) + percent * len(added)
                excess = weight - (100 - percent) * len(c)
                index = max(0, n + (-(weight + 1) // (100 + percent)) + 1)
                probe = max(0, n - max(1, -(-excess // (100 + percent))) + 1) if excess > 0 else 0
                rows.append((a, b, excess <= 0, added.view(np.int64), (~missing).view(np.int64), index, probe, weight, excess))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c_, k) for c_, k in zip(zip(*rows), kinds)], names=names)

    return around.mapInArrow(run, "a long, b long, linked boolean, added array<long>, missing array<long>, index int, probe int, weight long, excess long")


def components(spark, edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node that each can reach; large-star and small-star in turn.

    Minima are partly aggregated before the shuffle; each round is written to the shared folder.
    """
    edges = common.stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.stored(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.stored(spark, large.where("a <> b").distinct(), "edges")
        least = common.stored(spark, large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = common.stored(spark, small.where("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    centres = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))


def _members(reps: DataFrame) -> DataFrame:
    """(a, b): the centre of each bucket of several members, and another one of them."""
    spark = reps.sparkSession
    buckets = reps.select("node", F.explode("bands").alias("bucket"))
    shared = common.stored(spark, buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = common.stored(spark, buckets.join(shared, "bucket"), "members")
    # The centre is the member that meets most others in all its buckets: copies with few changes of their own do.
    weights = common.stored(spark, members.groupBy("node").agg(F.sum("n").alias("met")), "weights")
    weighed = members.join(weights, "node")
    best = common.stored(spark, weighed.groupBy("bucket").agg(F.max("met").alias("met")), "best")
    centres = common.stored(spark, weighed.join(best, ["bucket", "met"]).groupBy("bucket").agg(F.min("node").alias("centre")), "centres")
    return members.join(centres, "bucket").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def _ordered(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stars with members that are not linked to the centre; per member (a, b) the differences that another member has
    too, as structs n, difference, the rarest in the star first)."""
    spark = compared.sparkSession
    loose = common.stored(spark, compared.where("not linked").select("a").distinct(), "loose")
    around = compared.join(loose, "a", "left_semi")
    each = around.select("a", "b", F.explode(F.concat("added", "missing")).alias("difference"))
    counted = common.stored(spark, each.groupBy("a", "difference").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counted")
    order = each.join(counted, ["a", "difference"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "difference"))).alias("shared"))
    return around, common.stored(spark, order, "order")


def _gathered(around: DataFrame, order: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members that are not linked to their centre with other ones of the star that most of them share
    differences with: ROUNDS such second centres, so that a cluster beside the centre is found without its pairs."""
    spark = around.sparkSession
    popular = order.select("a", "b", F.aggregate("shared", F.lit(0).cast("long"), lambda t, s: t + s["n"]).alias("popular"))
    rest = around.where("not linked").select("a", "b", "weight", "excess", F.concat("added", "missing").alias("own")).join(popular.hint("merge"), ["a", "b"])
    rest = common.stored(spark, rest, "rest")
    links = None
    for _ in range(ROUNDS):
        centres = rest.groupBy("a").agg(F.max(F.struct("popular", "b")).alias("c")).select("a", F.col("c.b").alias("b"))
        centres = rest.select("a", F.col("b").alias("centre"), F.col("weight").alias("weight_c"), F.col("own").alias("own_c")).join(centres.withColumnRenamed("b", "centre"), ["a", "centre"])
        centres = common.stored(spark, centres, "second")
        near = F.size(F.array_intersect("own", "own_c")) * (100 + percent) >= F.col("excess") + F.col("weight_c")
        judged = rest.join(centres, "a").where("b <> centre").select("a", "b", "weight", "excess", "own", "popular", "centre", near.alias("near"))
        judged = common.stored(spark, judged, "judged")
        found = judged.where("near").select(F.col("centre").alias("a"), "b")
        links = found if links is None else links.unionByName(found)
        rest = judged.where("not near").drop("centre", "near")
    return links


def _beyond(around: DataFrame, order: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one star of which one at least is not linked to the centre, and which have different
    components by the links so far (labels: node, component)."""
    spark = around.sparkSession
    scalars = around.select("a", "b", "weight", "excess", "index", "probe", (F.size("added") + F.size("missing")).alias("size"))
    scalars = scalars.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    rows = order.join(scalars.hint("merge"), ["a", "b"])
    rows = rows.select("a", "b", "component", "weight", "excess", "size", "index", "probe", (F.col("size") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("k", "s"))
    rows = rows.withColumn("place", F.col("alone") + F.col("k")).where(F.col("place") < F.greatest("index", "probe"))
    asks, answers = (F.col("place") < F.col("probe")).alias("asks"), (F.col("place") < F.col("index")).alias("answers")
    entries = common.stored(spark, rows.select("a", F.col("s.difference").alias("difference"), "b", "component", "weight", "excess", "size", "place", asks, answers), "prefixes")
    # Where members of several components meet at a difference, all that are not of the largest one look around.
    parts = entries.groupBy("a", "difference", "component").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asked"))
    main = parts.groupBy("a", "difference").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("asked").alias("asked")).where("parts > 1 AND asked")
    met = common.stored(spark, entries.join(common.stored(spark, main.select("a", "difference", F.col("main.component").alias("main")), "main"), ["a", "difference"]), "meetings")

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("a", "difference", *(F.col(c).alias(f"{c}_{s}") for c in ("b", "component", "weight", "excess", "size", "place", "asks", "answers")))

    needed = F.ceil((F.col("excess_x") + F.col("weight_y")) / (100 + percent))
    # From the first shared difference on, the rest of both lists has to reach the number that must be shared.
    enough = needed <= F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    one_asks = F.expr("(asks_x AND answers_y) OR (asks_y AND answers_x)")
    pairs = side(met.where("component <> main"), "x").join(side(met, "y"), ["a", "difference"]).where((F.col("component_x") != F.col("component_y")) & one_asks & enough)
    # A pair that meets in several stars is confirmed in one of them.
    pairs = pairs.groupBy(F.least("b_x", "b_y").alias("x"), F.greatest("b_x", "b_y").alias("y")).agg(F.min("a").alias("a"))
    pairs = common.stored(spark, pairs, "met")
    sides = [around.select("a", F.col("b").alias(s), F.col("weight").alias(f"weight_{s}"), F.col("excess").alias(f"excess_{s}"), F.concat("added", "missing").alias(f"own_{s}")) for s in "xy"]
    whole = pairs.join(sides[0].hint("merge"), ["a", "x"]).join(sides[1].hint("merge"), ["a", "y"])
    # W(x) + W(y) - (100 - p) |centre|, and the shared differences counted in full: the threshold on the full sets.
    linked = F.size(F.array_intersect("own_x", "own_y")) * (100 + percent) >= F.col("excess_x") + F.col("weight_y")
    return whole.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _classes(stars: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the nodes with links."""
    spark = stars.sparkSession
    compared = common.stored(spark, _compared(_around(stars, own), size, percent), "compared")
    around, order = _ordered(compared)
    links = compared.where("linked").select("a", "b").unionByName(_gathered(around, order, percent))
    labels = common.stored(spark, components(spark, links), "components")
    found = common.stored(spark, _beyond(around, order, labels, percent), "links")
    if found.isEmpty():
        return labels
    # The links found last join whole components.
    label = [labels.select(F.col("node").alias(s), F.col("component").alias(f"component_{s}")) for s in "ab"]
    joined = found.join(label[0], "a", "left").join(label[1], "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    upper = common.stored(spark, components(spark, joined), "components")
    both = labels.join(upper.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    return both.select("node", F.coalesce("whole", "component").alias("component")).unionByName(upper.select("node", "component")).distinct()


def grouped(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest key of its component) and kept (whether that is its own)."""
    return _labelled(docs, percent, size, key, text).drop("at", "of")


def _labelled(docs: DataFrame, percent: int, size: int, key: str, text: str) -> DataFrame:
    """grouped(), with the row's own pair of longs."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    sets = common.stored(spark, sketched(docs, size, key, text), "sketches")
    # Each set is a node with a number of its own, which stays as it was written; one row's text stands for it.
    groups = sets.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("at", "of")).alias("first"), F.min("doc_id").alias("least"))
    groups = common.stored(spark, groups.select("set_a", "set_b", "n_shingles", "least", "first.*", F.monotonically_increasing_id().alias("node")), "sets")
    nodes = groups.select("at", "of", "node")
    reps = common.stored(spark, sets.join(nodes, ["at", "of"]).dropDuplicates(["at", "of", "node"]).select("node", "bands"), "representatives")
    stars = common.stored(spark, _members(reps), "stars")
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct().join(nodes, "node")
    # The texts move once, by a plan that does not turn with the number of keys.
    own = _texts(docs, key, text).select("at", "of", "text").join(wanted.hint("merge"), ["at", "of"]).dropDuplicates(["at", "of", "node"])
    own = common.stored(spark, own.select("node", "text"), "texts")
    labels = common.stored(spark, _classes(stars, own, size, percent), "labels")

    named = groups.join(labels, "node", "left").select("set_a", "set_b", "n_shingles", "least", F.coalesce("component", "node").alias("component"))
    named = common.stored(spark, named, "classes")
    own_label = named.groupBy("component").agg(F.min("least").alias("own"))
    by_set = named.join(own_label, "component").select("set_a", "set_b", "n_shingles", "own")
    found = sets.select("doc_id", "at", "of", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("own")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "at", "of", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """docs with one document of each component (the smallest doc_id); all columns stay.

    Rows that are repeated whole stay or go together, and so do rows without a key in a component without any.
    """
    at, of = common.fresh(docs, "at", "of")
    drop = _labelled(docs, percent, size, "doc_id", "text").where(~F.col("kept")).select(F.col("at").alias(at), F.col("of").alias(of)).distinct()
    key, hashed = common.row_key(F.col("doc_id"), F.col("text").cast("string"))
    return docs.withColumns({at: key, of: hashed}).join(drop.hint("merge"), [at, of], "left_anti").select(*docs.columns)
