"""Size-tiered compaction of shards under a versioned manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File sizes: tier k holds shards of up to BASE * FANOUT ** k bytes; none is merged once it has the target size.
TARGET_BYTES, BASE_BYTES, FANOUT = 128 << 20, 1 << 20, 4


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    """An immutable Parquet file."""

    path: str
    bytes: int
    rows: int


class ShardTable:
    """Parquet shards and numbered manifests in a folder that driver and executors share.

    A manifest lists the shards of a version. It is written beside its final name and renamed to it, which fails if the
    version exists: readers see a version whole or not at all, and of two writers one gets Conflict. Data files are
    never changed; those that no manifest lists (of tasks that died, or of a lost race) are never read. The manifests
    hold names and counts alone, a line a shard; rows go from executors to files.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.base, self.fanout = spark, root.rstrip("/"), target_bytes, base_bytes, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the newest; none before the first commit."""
        all_ = self.versions()
        if not all_:
            return []
        lines = self.spark.read.text(f"{self.root}/manifest/v={version or all_[-1]}").collect()
        return [Shard(**json.loads(r[0])) for r in lines]

    def commit(self, shards: list[Shard], expected: int) -> int:
        """Makes shards the version after expected."""
        staged, final = f"{self.root}/manifest/_staged-{uuid.uuid4().hex}", f"{self.root}/manifest/v={expected + 1}"
        lines = self.spark.createDataFrame([(json.dumps(asdict(s)),) for s in shards], "value string")
        lines.coalesce(1).write.text(staged)
        if self._fs.exists(self._path(final)) or not self._fs.rename(self._path(staged), self._path(final)):
            raise Conflict(f"version {expected + 1} exists")
        if self._fs.exists(self._path(f"{final}/{staged.rpartition('/')[2]}")):  # renamed into it: it existed after all
            raise Conflict(f"version {expected + 1} exists")
        return expected + 1

    def _write(self, df: DataFrame) -> list[Shard]:
        """Writes df's partitions as files; sizes from the file system, row counts from the files' footers."""
        out = f"{self.root}/data/{uuid.uuid4().hex[:16]}"
        df.write.option("compression", "zstd").parquet(out)
        files = [s for s in self._fs.listStatus(self._path(out)) if s.getPath().getName().endswith(".parquet")]
        counts = {r[0]: r[1] for r in self.spark.read.parquet(out).groupBy(F.col("_metadata.file_name")).count().collect()} if files else {}
        return [Shard(f"{out}/{n}", s.getLen(), counts.get(n, 0)) for s in files if (n := s.getPath().getName()) and (counts.get(n) or not counts)]

    def append(self, rows: DataFrame) -> int:
        """Commits rows as new shards, one for each partition that has rows; partitions stay where they are."""
        version = (self.versions() or [0])[-1]
        return self.commit(self.manifest() + self._write(rows), version)

    def _tier(self, size: int) -> int:
        tier = 0
        while size > self.base * self.fanout**tier:
            tier += 1
        return tier

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: in each tier of shards below the target, runs of fanout and more, filled up to the target."""
        groups = []
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < 0.75 * self.target:
                tiers.setdefault(self._tier(s.bytes), []).append(s)
        for _, run in sorted(tiers.items()):
            if len(run) < self.fanout:
                continue
            group: list[Shard] = []
            for s in sorted(run, key=lambda s: (s.bytes, s.path)):
                if group and sum(x.bytes for x in group) + s.bytes > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, final: bool = False) -> int:
        """Merges the planned groups, one new file each, in one job without a shuffle, and commits; repeats until no
        tier has enough shards. final: merges what is left below the target as well."""
        while True:
            version, shards = (self.versions() or [0])[-1], self.manifest()
            groups = self.plan(shards)
            if not groups and final and len(small := [s for s in shards if s.bytes < 0.75 * self.target]) > 1:
                tables = ShardTable(self.spark, self.root, self.target, self.target, 2)
                groups, final = tables.plan(small), False
            if not groups:
                return version
            gone = {s.path for g in groups for s in g}
            schema = self.spark.read.parquet(*sorted(gone)[:1]).schema
            merged = None
            for g in groups:
                part = self.spark.read.schema(schema).parquet(*[s.path for s in g]).coalesce(1)
                merged = part if merged is None else merged.unionByName(part)
            self.commit([s for s in shards if s.path not in gone] + self._write(merged), version)

    def expire(self, keep: int = 1) -> None:
        """Deletes all versions but the newest, and the files that only they list."""
        old = self.versions()[:-keep]
        live = {s.path for v in self.versions()[-keep:] for s in self.manifest(v)}
        dead = {s.path for v in old for s in self.manifest(v)} - live
        for path in [*dead, *(f"{self.root}/manifest/v={v}" for v in old)]:
            self._fs.delete(self._path(path), True)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version."""
        paths = [s.path for s in self.manifest(version)]
        if not paths:
            return self.spark.createDataFrame([], schema or "doc_id long")
        return self.spark.read.parquet(*paths)


def ingest(table: ShardTable, rows: DataFrame, arrivals: int = 4, by: str = "doc_id") -> DataFrame:
    """Appends rows in arrivals by ranges of the column by, compacting after each, and returns the newest version's rows.

    Every row is kept as it is: nulls in any column (a null in by comes with the first arrival), repeated rows, empty
    and long texts, extra columns. An empty table: an empty result of the same columns.
    """
    cuts = sorted(set(rows.agg(F.percentile_approx(by, [k / arrivals for k in range(1, arrivals)])).first()[0] or [])) if arrivals > 1 else []
    limits = [None, *cuts, None]
    for low, high in zip(limits, limits[1:], strict=False):
        part = rows
        if low is not None:
            part = part.where(F.col(by) > low)
        if high is not None:
            part = part.where((F.col(by) <= high) | F.col(by).isNull()) if low is None else part.where(F.col(by) <= high)
        table.append(part)
        table.compact(final=high is None)
        table.expire()
    return table.read(schema=rows.schema)
