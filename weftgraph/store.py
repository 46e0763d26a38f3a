"""The graph as versioned Parquet: every commit writes new table versions beside the old ones and then moves one pointer.

A store is a folder on any file system that Spark reaches. A pointer file, one per generation, names the version of
each table; the highest generation is the current one, so a commit is one atomic rename and a torn one is invisible.
All files go through Hadoop's file system API, never through local paths.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions.scalars import unsafe_path_reason
from .schema import BY_FILE, KEYS, SCHEMA_VERSION, TABLES


class StoreError(RuntimeError):
    pass


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pending: dict[str, str] = {}
        self._meta: dict[str, str] = {}
        self._state = self._load()

    # --- pointer files

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _load(self) -> dict:
        fs, p = self._fs(f"{self.root}/generations")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        known = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not known:
            return {"schema_version": SCHEMA_VERSION, "generation": 0, "tables": {}, "meta": {}}
        state = json.loads(self._read_text(f"{self.root}/generations/{known[-1]:010d}.json"))
        if state["schema_version"] > SCHEMA_VERSION:
            raise StoreError(f"written by a later schema version {state['schema_version']}")
        return state

    def commit(self) -> int:
        """Make the pending tables and meta values current; a commit by someone else in between raises."""
        new = dict(self._state, schema_version=SCHEMA_VERSION, generation=self._state["generation"] + 1, tables=self._state["tables"] | self._pending, meta=self._state["meta"] | self._meta)
        target = f"{self.root}/generations/{new['generation']:010d}.json"
        temporary = f"{self.root}/generations/.{uuid.uuid4().hex}"
        fs, p = self._fs(temporary)
        out = fs.create(p)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        goal = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(goal) or not fs.rename(p, goal):
            fs.delete(p, False)
            raise StoreError(f"generation {new['generation']} was committed by another writer")
        self._state, self._pending, self._meta = new, {}, {}
        return new["generation"]

    def rollback(self) -> None:
        self._pending, self._meta = {}, {}

    @property
    def generation(self) -> int:
        return self._state["generation"]

    def meta(self, key: str) -> str | None:
        return (self._state["meta"] | self._meta).get(key)

    def set_meta(self, key: str, value: str) -> None:
        self._meta[key] = value

    # --- tables

    def table(self, name: str) -> DataFrame:
        path = (self._state["tables"] | self._pending).get(name)
        return self.spark.createDataFrame([], TABLES[name]) if path is None else self.spark.read.schema(TABLES[name]).parquet(path)

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows of a table; columns that the schema does not know are left out, missing ones are null."""
        have = set(rows.columns)
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        own = rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        own.write.option("compression", "zstd").parquet(path)
        self._pending[name] = path

    def upsert(self, name: str, rows: DataFrame, keep_existing: bool = False, order: str | None = None) -> None:
        """Rows replace those with their key, or give way to them; among new rows of one key the last stays, by a column or
        as they come."""
        keys = KEYS[name]
        last = F.desc(order) if order is not None else F.desc("_seq")
        place = F.row_number().over(W.partitionBy(*keys).orderBy(last))
        rows = rows.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_place", place).where("_place = 1").drop("_place", "_seq")
        old = self.table(name)
        if keep_existing:
            self.replace(name, old.unionByName(rows.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True))
        else:
            self.replace(name, old.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete_files(self, files: DataFrame, tables: tuple[str, ...] = BY_FILE) -> None:
        """Everything that belongs to the files (column file_path), and the vectors of their nodes."""
        gone = files.select("file_path").distinct()
        if "nodes" in tables and "vectors" in self._state["tables"] | self._pending:
            ids = self.table("nodes").join(gone, "file_path", "left_semi").select("id")
            self.replace("vectors", self.table("vectors").join(ids, "id", "left_anti"))
        for name in tables:
            self.replace(name, self.table(name).join(gone, "file_path", "left_anti"))

    def save_by_file(self, name: str, rows: DataFrame, files: DataFrame) -> None:
        """The rows of the given files replace what the table has of these files."""
        kept = self.table(name).join(files.select("file_path").distinct(), "file_path", "left_anti")
        self.replace(name, kept.unionByName(rows, allowMissingColumns=True))

    def delete_edges(self, files: DataFrame | None = None, tier: str | None = None) -> None:
        """All edges, or those of some source files, or only those of one tier among them."""
        edges = self.table("edges")
        if files is None and tier is None:
            return self.replace("edges", edges.limit(0))
        gone = edges if files is None else edges.join(files.select(F.col("file_path").alias("src_file")).distinct(), "src_file", "left_semi")
        gone = gone if tier is None else gone.where(F.col("tier") == tier)
        return self.replace("edges", edges.join(gone.select(*KEYS["edges"]), KEYS["edges"], "left_anti"))

    def update_analytics(self, values: DataFrame) -> None:
        """id with any of community, pagerank, betweenness, fan_in, fan_out."""
        own = [c for c in values.columns if c != "id"]
        nodes = self.table("nodes")
        joined = nodes.join(values.select("id", *(F.col(c).alias(f"_{c}") for c in own)), "id", "left")
        self.replace("nodes", joined.select(*((F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c)) for c in nodes.columns)))

    def hyperedges_for(self, node_id: str) -> DataFrame:
        return self.table("hyperedges").where(F.exists("members", lambda m: m["node_id"] == node_id))

    def contexts_for(self, path: str) -> DataFrame:
        """Summaries of the path and of everything around it, the oldest first."""
        return self.table("contexts").where(F.lit(path).startswith(F.col("path"))).orderBy("added_at", "path")

    def unsafe_paths(self) -> DataFrame:
        """(table, path, reason) of stored paths that do not stay inside the repository."""
        found = None
        for name in (*BY_FILE, "manifest"):
            own = self.table(name).select(F.lit(name).alias("table"), F.col("file_path").alias("path")).where("path IS NOT NULL").distinct().withColumn("reason", unsafe_path_reason("path")).where("reason IS NOT NULL")
            found = own if found is None else found.unionByName(own)
        return found

    def canonical_hash(self) -> str:
        """Of all nodes and edges without analytics: row hashes are added up, so no order and no single task is needed."""
        parts_of = []
        for name in ("nodes", "edges"):
            frame = self.table(name)
            row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(frame.columns) if c not in ("community", "pagerank", "betweenness", "fan_in", "fan_out"))), {"ignoreNullFields": "false"}), 256)
            parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
            sums = frame.agg(F.count(F.lit(1)), *(F.sum(p) for p in parts)).first()
            parts_of.append((name, *(int(x or 0) for x in sums)))
        return hashlib.sha256(repr(parts_of).encode()).hexdigest()

    # --- artifacts

    def export(self, path: str) -> None:
        """All current tables as zstd Parquet with a manifest of row counts."""
        counts = {}
        for name in self._state["tables"]:
            self.table(name).write.option("compression", "zstd").parquet(f"{path}/{name}")
            counts[name] = self.table(name).count()
        self.spark.createDataFrame([(json.dumps({"schema_version": SCHEMA_VERSION, "generation": self.generation, "tables": counts}),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    def import_(self, path: str, most_rows: int | None = None) -> int:
        """Check an exported graph, then make it current: schema version, row counts, paths and edges that lead nowhere."""
        manifest = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])
        if manifest["schema_version"] > SCHEMA_VERSION:
            raise StoreError("exported by a later schema version")
        if most_rows is not None and sum(manifest["tables"].values()) > most_rows:
            raise StoreError(f"more than {most_rows} rows")
        for name, count in manifest["tables"].items():
            if name not in TABLES:
                raise StoreError(f"unknown table {name}")
            frame = self.spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")
            if frame.count() != count:
                raise StoreError(f"{name} does not have {count} rows")
            self.replace(name, frame)
        if not self.unsafe_paths().isEmpty():
            self.rollback()
            raise StoreError("paths outside the repository")
        from .operators.lookups import without_dangling

        self.replace("edges", without_dangling(self.table("nodes"), self.table("edges")))
        return self.commit()
