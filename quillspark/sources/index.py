"""A collection's index as tables in a folder, rebuilt or kept up to date file by file.

Each table lies in buckets by a hash of its key. A change writes the buckets it touches anew, below a folder of the next
version, then one manifest that names the folders of every bucket. Readers take the newest manifest, so a run that
fails midway leaves the old state, and of two runs at once the second to finish fails. Nothing of the collection's size
reaches the driver: manifests grow with tables times buckets only.

Which files are read anew: one whose time is unchanged is skipped; one whose content hash is unchanged only gets its new
time; others are parsed. An id that a file on disk holds in the index stays with that file for the run; of several new
files with one id the first path gets it; the rest are duplicates and are tried again by the next run. A file under a new
path with the id of one that is gone is a move. A file that now declares another id takes its history with it.
Links keep the texts they name, and edges() resolves them against the present notes, so that links to a deleted note are
unresolved, as after a rebuild.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as L
from ..operators import structure as S
from . import markdown as M

#: Tables with the column that deals their rows to buckets.
TABLES = {
    "catalog": ("path", "path string, hash string, mtime long, id string"),
    "notes": ("id", "id string, path string, type string, title string, status string, created string, updated string, extra map<string,array<string>>, body_text string, body string, is_domain boolean"),
    "tags": ("id", "id string, tag string"),
    "aliases": ("id", "id string, alias string"),
    "headings": ("id", "id string, line int, level int, title string, slug string"),
    "blocks": ("id", "id string, line int, block_id string, heading string"),
    "links": ("src", "src string, raw string, edge_type string, target_kind string, heading string, block string, confidence string, origin string"),
    "accesses": ("id", "id string, ts timestamp, caller string"),
}


def classified(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, change, old_id): added, changed, touched, same or deleted, for files and catalogue (path, hash, mtime, id).

    Null paths are left out; of repeated paths in either one row is taken, that of the greatest time."""
    newest = lambda df, *cols: df.filter("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "hash", *cols)).alias("x"))
    now = newest(files).select("path", F.col("x.mtime").alias("m"), F.col("x.hash").alias("h"), F.lit(True).alias("on_disk"))
    was = newest(catalog, "id").select("path", F.col("x.mtime").alias("old_m"), F.col("x.hash").alias("old_h"), F.col("x.id").alias("old_id"), F.lit(True).alias("stored"))
    change = (
        F.when(F.col("stored").isNull(), "added")
        .when(F.col("on_disk").isNull(), "deleted")
        .when(F.col("m").eqNullSafe(F.col("old_m")), "same")
        .when(F.col("h").eqNullSafe(F.col("old_h")), "touched")
        .otherwise("changed")
    )
    return now.join(was, "path", "full_outer").select("path", change.alias("change"), "old_id")


def settled(changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """(path, action, id, old_id, holder) of every change but same.

    changes: as classified() gives them. parsed: (path, id) of what was added or changed. action: store, duplicate (of the
    holder's path), touch, or delete; a deleted path whose id another file takes is moved."""
    held = changes.filter("change <> 'deleted' and old_id is not null").select(F.col("old_id").alias("id"), F.struct(F.lit(0).alias("o"), "path").alias("claim"))
    new = parsed.filter("id is not null").select("id", F.struct(F.lit(1).alias("o"), "path").alias("claim"))
    holders = held.unionByName(new).groupBy("id").agg(F.min("claim")["path"].alias("holder"))
    asked = changes.join(parsed.select("path", "id"), "path", "left").filter("change <> 'same'")
    ids = F.when(F.col("change").isin("deleted", "touched"), F.col("old_id")).otherwise(F.col("id"))
    both = asked.withColumn("id", ids).join(holders, "id", "left")
    action = (
        F.when(F.col("change") == "touched", "touch")
        .when((F.col("change") == "deleted") & F.col("holder").isNotNull(), "move")
        .when(F.col("change") == "deleted", "delete")
        .when(F.col("holder") == F.col("path"), "store")
        .otherwise("duplicate")
    )
    told = both.withColumn("action", action)
    return told.select("path", "action", "id", "old_id", F.when(F.col("action").isin("duplicate", "move"), F.col("holder")).alias("holder"))


class NoteIndex:
    """The tables below a folder. buckets: fixed when the folder is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self._manifest().get("buckets", buckets)

    def versions(self) -> list[int]:
        """Numbers of the states that can be read, the newest last."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}}
        (row,) = self.spark.read.text(f"{self.root}/manifest/{known[-1] if version is None else version}.json", wholetext=True).collect()
        return json.loads(row.value)

    def _commit(self, state: dict) -> None:
        """Renaming fails if another run has written that version meanwhile."""
        end = self._path(f"{self.root}/manifest/{state['version']}.json")
        begun = self._path(f"{self.root}/manifest/.{state['version']}-{self.spark.sparkContext.applicationId}")
        out = self._fs.create(begun, True)
        out.write(bytearray(json.dumps(state | {"buckets": self.buckets}).encode()))
        out.close()
        if self._fs.exists(end) or not self._fs.rename(begun, end):
            raise RuntimeError(f"version {state['version']} of {self.root} was written by another run")

    def _read(self, state: dict, name: str, only: set[int] | None = None) -> DataFrame:
        held = state["tables"].get(name, {})
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, vs in held.items() if only is None or int(b) in only for v in vs]
        schema = TABLES[name][1]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self._manifest(version), name)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, state: dict, name: str, rows: DataFrame, touched: set[int], replace: bool = True) -> None:
        """Puts rows into the touched buckets of the next version, instead of or beside what they hold."""
        key, schema = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        new = rows.select(*columns).withColumn("bucket", self.bucket(F.col(key)))
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/v={state['version']}")
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}/v={state['version']}"))}
        held = state["tables"].setdefault(name, {})
        for b in touched:
            added = [state["version"]] if f"bucket={b}" in there else []
            held[str(b)] = (held.get(str(b), []) if not replace else []) + added

    def _touched(self, ids: DataFrame) -> set[int]:
        """Numbers of buckets, so never more than there are."""
        return {r[0] for r in ids.select(self.bucket(F.col(ids.columns[0])).alias("b")).distinct().collect()}

    def update(self, files: DataFrame) -> dict[str, int]:
        """Brings the index up to the files (path, mtime, content, hash) and returns the numbers of actions."""
        state = self._manifest()
        first = state["version"] == 0
        state["version"] += 1
        catalog = self._read(state, "catalog")
        seen = classified(files.select("path", "mtime", "hash"), catalog)
        fresh = files.join(seen.filter("change in ('added', 'changed')").select("path"), "path", "left_semi").dropDuplicates(["path"])
        work = f"{self.root}/work/v={state['version']}"
        M.notes(fresh).write.mode("overwrite").parquet(f"{work}/parsed")
        parsed = self.spark.read.parquet(f"{work}/parsed")
        settled(seen, parsed).write.mode("overwrite").parquet(f"{work}/plan")
        plan = self.spark.read.parquet(f"{work}/plan")
        counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        if not first and not counts.keys() - {"duplicate"}:
            return counts
        stored = plan.filter("action = 'store'")
        notes = parsed.join(stored.select("path"), "path", "left_semi")
        gone = stored.select(F.col("old_id").alias("id")).union(stored.select("id")).union(plan.filter("action = 'delete'").select("id")).filter("id is not null").distinct()
        by_id, by_path = self._touched(gone), self._touched(plan.filter("action <> 'duplicate'").select("path"))

        kept = catalog.join(plan.filter("action in ('store', 'delete', 'move')").select("path"), "path", "left_anti")
        times = files.groupBy("path").agg(F.max("mtime").alias("m")).join(plan.filter("action = 'touch'").select("path"), "path", "left_semi")
        kept = kept.join(times, "path", "left").select("path", "hash", F.coalesce("m", "mtime").alias("mtime"), "id")
        self._write(state, "catalog", kept.filter(self.bucket(F.col("path")).isin(sorted(by_path)) if by_path else F.lit(False)).unionByName(notes.select("path", "hash", "mtime", "id")), by_path)

        news = {
            "notes": notes,
            "tags": notes.select("id", F.explode("tags").alias("tag")).distinct(),
            "aliases": notes.select("id", F.explode("aliases").alias("alias")).distinct(),
            "headings": S.headings(notes),
            "blocks": S.blocks(notes),
            "links": M.links(notes),
        }
        for name, rows in news.items():
            key = TABLES[name][0]
            old = self._read(state, name, by_id).join(gone.withColumnRenamed("id", key), key, "left_anti")
            self._write(state, name, old.unionByName(rows.select(*old.columns)), by_id)
        self._carry(state, stored, plan)
        self._commit(state)
        self._fs.delete(self._path(work), True)
        return counts

    def _carry(self, state: dict, stored: DataFrame, plan: DataFrame) -> None:
        """The history of re-keyed notes goes to their new ids, that of deleted ones goes."""
        moved = stored.filter("old_id <> id").select(F.col("old_id").alias("id"), F.col("id").alias("new_id"))
        lost = plan.filter("action = 'delete'").select("id", F.lit(None).cast("string").alias("new_id"))
        away = moved.unionByName(lost)
        touched = self._touched(away.select("id").union(moved.select("new_id")))
        old = self._read(state, "accesses", touched)
        rows = old.join(away.withColumn("away", F.lit(True)), "id", "left").filter("away is null or new_id is not null")
        self._write(state, "accesses", rows.withColumn("id", F.coalesce("new_id", "id")), touched)

    def rebuild(self, files: DataFrame) -> dict[str, int]:
        """All from the files alone, but for the history of notes that are there again."""
        state = self._manifest()
        history, version = self._read(state, "accesses"), state["version"]
        fresh = NoteIndex(self.spark, f"{self.root}/work/rebuilt-{version + 1}", self.buckets)
        counts = fresh.update(files)
        state = {"version": version + 1, "tables": {}}
        every = set(range(self.buckets))
        for name in TABLES:
            rows = fresh.table(name) if name != "accesses" else history.join(fresh.table("notes").select("id"), "id", "left_semi")
            self._write(state, name, rows, every)
        self._commit(state)
        self._fs.delete(self._path(fresh.root), True)
        return counts

    def record(self, accesses: DataFrame) -> None:
        """Adds accesses (id, ts, caller) of known notes."""
        state = self._manifest()
        state["version"] += 1
        known = accesses.join(self._read(state, "notes").select("id"), "id", "left_semi")
        self._write(state, "accesses", known, set(range(self.buckets)), replace=False)
        self._commit(state)

    def edges(self) -> DataFrame:
        """The links with their targets as they are now: src, raw, edge_type, ..., dst, pass."""
        notes = self.table("notes")
        return L.resolve(self.table("links"), notes.select("id", "title", "path"), self.table("aliases"))

    def vacuum(self, keep: int = 2) -> int:
        """Removes what no manifest of the last `keep` states names, and older manifests; the number of folders removed."""
        known = self.versions()
        held = {(name, v) for k in known[-keep:] for name, bs in self._manifest(k)["tables"].items() for vs in bs.values() for v in vs}
        n = 0
        for name in TABLES:
            folder = self._path(f"{self.root}/{name}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                version = int(s.getPath().getName().removeprefix("v="))
                if (name, version) not in held and version <= known[-1]:
                    n += self._fs.delete(s.getPath(), True)
        for k in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/{k}.json"), False)
        return n
