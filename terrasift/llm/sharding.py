"""Sharded storage with size-tiered compaction and versioned manifests.

Arrivals are appended as runs: folders of small immutable shards. Compaction takes a tier, the runs whose shards are of
similar size, and rewrites some of its runs at a time as one run of shards near the target size; a shard is one task's rows. A
version of the table is a manifest that names its runs; it is written aside and renamed into place without overwriting, so of
two writers one fails, and readers see all of a change or nothing. Runs that no kept manifest names are deleted by vacuum().

The driver and the manifests hold a line per run, with its numbers of shards, bytes and rows, and never a list of shards: which
shard a row is merged into follows from the path it is read from.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrasift.llm.common import free, unused


@dataclass
class Run:
    path: str
    shards: int
    bytes: int
    rows: int


class ShardedTable:
    """A table in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    # Manifests

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:9]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run], StructType | None]:
        """Version, runs and schema; version 0 is the empty table before the first commit."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, [], None
        stream = self.fs.open(self.path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            raw = json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return version, [Run(**r) for r in raw["runs"]], StructType.fromJson(raw["schema"])

    def commit(self, version: int, runs: list[Run], schema: StructType) -> None:
        """Make this the version after `version`; fails if another writer has."""
        raw = json.dumps({"version": version + 1, "schema": schema.jsonValue(), "runs": [asdict(r) for r in runs]}).encode()
        aside, place = self.path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self.path(f"{self.root}/manifest/v{version + 1:08d}.json")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(raw))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf).rename(aside, place, none)
        except Exception as e:
            self.fs.delete(aside, False)
            raise RuntimeError(f"version {version + 1} exists: another writer committed first") from e

    # Runs

    def written(self, folder: str) -> list[Run]:
        """The runs in a folder, its subfolders, as they were written; those without rows are none."""
        if not self.fs.exists(self.path(folder)):
            return []
        names = [s.getPath().toString() for s in self.fs.listStatus(self.path(folder)) if s.isDirectory()]
        if not names:
            return []
        run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        # Counted from the footers; a row per run comes to the driver.
        counts = self.spark.read.parquet(*names).groupBy(run.alias("run")).agg(F.count("*").alias("n"))
        rows = {r["run"]: r["n"] for r in counts.collect()}
        out = []
        for name in sorted(names):
            size = self.fs.getContentSummary(self.path(name))
            if n := rows.get(name.rpartition("/")[2], 0):
                out.append(Run(name, size.getFileCount(), size.getLength(), n))
        return out

    def append(self, df: DataFrame, rows_per_shard: int = 1000, runs: int = 8) -> int:
        """Add df as at most `runs` runs of shards of at most rows_per_shard rows; returns the version. The rows go where
        they are: no shuffle. An empty df makes a version without new runs. Columns must be those of the table."""
        version, held, schema = self.manifest()
        if schema is not None and [f.name for f in schema] != df.columns:
            raise ValueError(f"columns {df.columns} are not those of the table: {schema.names}")
        folder, run = f"{self.root}/data/{uuid.uuid4().hex}", unused(df.columns, "run")
        part = F.pmod(F.spark_partition_id(), F.lit(runs))
        df.withColumn(run, part).write.option("maxRecordsPerFile", rows_per_shard).partitionBy(run).parquet(folder)
        self.commit(version, held + self.written(folder), schema or df.schema)
        return version + 1

    def plan(self, runs: list[Run], target_bytes: int, least_runs: int, ratio: int) -> list[list[Run]]:
        """Sets of runs to merge: least_runs of a tier at a time, in order. A tier's last runs join its last set; if it has
        too few runs, they wait, unless there is only one tier left to merge within and its shards are many."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if r.bytes / r.shards < target_bytes / 2:
                tiers.setdefault(int(math.log(max(r.bytes / r.shards, 1), ratio)), []).append(r)
        sets = []
        for tier in tiers.values():
            tier = sorted(tier, key=lambda r: r.path)
            cuts = range(0, max(len(tier) - least_runs + 1, 1), least_runs)
            parts = [tier[a : a + least_runs] for a in cuts]
            parts[-1] = tier[cuts[-1] :]
            sets += [p for p in parts if sum(r.shards for r in p) >= least_runs and self.outputs(p, target_bytes) < sum(r.shards for r in p)]
        return sets

    @staticmethod
    def outputs(runs: list[Run], target_bytes: int) -> int:
        return max(1, round(sum(r.bytes for r in runs) / target_bytes))

    def compact(self, target_bytes: int = 256 << 20, least_runs: int = 4, ratio: int = 4, keep: int | None = None) -> int:
        """Merge until no tier has runs to merge; returns the version. Each set of runs is one job and one commit, so old and
        new shards and the shuffle of only one set meet on disk. With keep, older versions than the last `keep` are deleted
        after each."""
        version, runs, schema = self.manifest()
        while sets := self.plan(runs, target_bytes, least_runs, ratio):
            merged, n = sets[0], self.outputs(sets[0], target_bytes)
            out, run = unused(schema.names, "shard"), unused(schema.names, "run")
            rows = self.spark.read.schema(schema).parquet(*(r.path for r in merged))
            # A shard's rows go on together; whose path it is decides where.
            rows = rows.withColumn(out, F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(n)).cast("int"))
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows.repartitionById(n, F.col(out)).drop(out).withColumn(run, F.lit(0)).write.partitionBy(run).parquet(folder)
            made = self.written(folder)
            if sum(r.rows for r in made) != sum(r.rows for r in merged):
                raise RuntimeError("merged runs don't hold the rows of those they replace; nothing was committed")
            gone = {r.path for r in merged}
            runs = [r for r in runs if r.path not in gone] + made
            self.commit(version, runs, schema)
            version += 1
            if keep:
                self.vacuum(keep)
            free(self.spark)
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last `keep`, and runs that none of these names; returns how many runs went. Not to be
        run while another writer is at work: its runs aren't named yet."""
        versions = self.versions()
        named = {r.path for v in versions[-keep:] for r in self.manifest(v)[1]}
        for v in versions[:-keep]:
            self.fs.delete(self.path(f"{self.root}/manifest/v{v:08d}.json"), False)
        stale = 0
        for batch in self.fs.listStatus(self.path(f"{self.root}/data")):
            runs = [s.getPath() for s in self.fs.listStatus(batch.getPath()) if s.isDirectory()]
            old = [p for p in runs if p.toString() not in named]
            for p in [batch.getPath()] if len(old) == len(runs) else old:
                self.fs.delete(p, True)
            stale += len(old)
        return stale

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if None; its columns in their order."""
        _, runs, schema = self.manifest(version)
        if schema is None:
            raise ValueError(f"{self.root} has no version yet")
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(r.path for r in runs))


def shard(docs: DataFrame, root: str, rows_per_shard: int = 1000, target_bytes: int = 32 << 20, least_runs: int = 2, ratio: int = 4) -> ShardedTable:
    """Append docs to the table at root, compact it, and delete what was replaced.

    Every row and column comes back as it was, whatever the columns' names: nulls, empty and long texts, ties and repeated
    rows too; an empty table makes an empty version.
    """
    table = ShardedTable(docs.sparkSession, root)
    table.append(docs, rows_per_shard)
    table.compact(target_bytes, least_runs, ratio, keep=1)
    table.vacuum()
    return table
