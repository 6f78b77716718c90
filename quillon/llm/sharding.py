"""Sharding: a store of immutable shards under size-tiered compaction.

Method: arrivals are appended as small Parquet shards that never change.  Shards whose
sizes lie in the same tier (powers of ``fan_in`` of the smallest size) form a run;
when a tier holds ``fan_in`` shards or more they are merged into files of about
``target_bytes``, which then belong to a higher tier; files of the target size are
left alone.  What the store holds is said by a manifest: a numbered JSON file with the
live shards.  A commit writes it to a temporary name and gives it the next number in one
step that fails when another writer has taken the number (a hard link on local disks, a
rename elsewhere, which HDFS refuses over an existing file; object stores without such a
rename need one writer); readers see one version or the next.  Shards stay as long as a
version that names them is kept: ``vacuum`` forgets versions and deletes what no other
version names.

Scale: merging reads small files and writes large ones, without a shuffle.  A run is
read by as many tasks as it makes files of about ``target_bytes``, each task writing one.
The driver holds the manifest (a line per shard: 10^5 of 512 MB for 50 TB) and no rows.
A lost task is run again; files of failed attempts are in no manifest.

Cases: nulls, empty and very long texts, repeated rows and any columns, whatever their
names, are stored as they are; the schema is that of the first arrivals, and later ones
must have its columns, by name, with the same types; appending an empty table commits a
version without new shards; a store that nothing was appended to has no schema, and reads
as a table without columns and rows.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.llm.common import create_once, delete, hadoop_path

TARGET_BYTES = 128 << 20
FAN_IN = 4


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    bytes: int
    rows: int


class ConflictError(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class ShardStore:
    """Immutable shards and versioned manifests below one folder."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, smallest: int = 1 << 20):
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.smallest = target_bytes, fan_in, smallest

    # manifests

    def version(self) -> int:
        """Number of the last commit, 0 if none."""
        fs, p = hadoop_path(self.spark, f"{self.root}/_manifest")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = hadoop_path(self.spark, f"{self.root}/_manifest/v{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        found["shards"] = [Shard(**s) for s in found["shards"]]
        return found

    def _commit(self, before: dict, shards: list[Shard], schema: str) -> int:
        version = before["version"] + 1
        body = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        fs, temp = hadoop_path(self.spark, f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        _, final = hadoop_path(self.spark, f"{self.root}/_manifest/v{version:08d}.json")
        out = fs.create(temp, False)
        try:
            out.write(bytearray(body.encode()))
            if hasattr(out, "hsync"):
                out.hsync()
        finally:
            out.close()
        if not create_once(self.spark, temp, final):
            raise ConflictError(f"version {version} is there already")
        return version

    # shards

    def _write(self, df: DataFrame, most_rows: int = 0) -> list[Shard]:
        """Write files, one per task or per ``most_rows`` rows, into a fresh folder; those that have rows."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(f"{self.root}/{folder}")
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        size = {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}
        if not size:
            return []
        # a row per shard; no column of the rows is read
        counts = self.spark.read.schema(StructType([])).parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        for name in size.keys() - {r["f"] for r in counts}:  # files without rows
            fs.delete(hadoop_path(self.spark, f"{self.root}/{folder}/{name}")[1], False)
        return sorted((Shard(f"{folder}/{r['f']}", size[r["f"]], r["count"]) for r in counts), key=lambda s: s.path)

    def append(self, arrivals: DataFrame, rows_per_shard: int | None = None) -> int:
        """Add rows as new shards, one per task or per ``rows_per_shard`` rows; the new version."""
        before = self.manifest()
        schema = before["schema"] or arrivals.schema.json()
        fields = StructType.fromJson(json.loads(schema)).fields
        came = {f.name: f.dataType for f in arrivals.schema.fields}
        wrong = [f.name for f in fields if f.name not in came or came[f.name].simpleString() != f.dataType.simpleString()]
        if wrong:
            raise TypeError(f"columns that are missing or have another type: {', '.join(wrong)}")
        new = self._write(arrivals.select(*[F.col(f"`{f.name.replace('`', '``')}`") for f in fields]), rows_per_shard or 0)
        return self._commit(before, before["shards"] + new, schema)

    def tier(self, size: int) -> int:
        return 0 if size <= self.smallest else int(math.log(size / self.smallest, self.fan_in))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards that are due to be merged."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fan_in]

    def compact(self) -> int:
        """Merge runs until none is due; each round is one commit.  The last version."""
        while True:
            before = self.manifest()
            runs = self.plan(before["shards"])
            if not runs:
                return before["version"]
            schema = StructType.fromJson(json.loads(before["schema"]))
            merged, gone = [], set()
            for run in runs:
                rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run])
                files = max(1, round(sum(s.bytes for s in run) / self.target_bytes))
                merged += self._write(rows.coalesce(files))
                gone |= {s.path for s in run}
            version = self._commit(before, [s for s in before["shards"] if s.path not in gone] + merged, before["schema"])
            if len(merged) >= len(gone):  # nothing was gained: tasks write at least a file each
                return version

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete the shards that only those named; how many went."""
        if keep < 1:
            raise ValueError("the last version stays")
        fs, p = hadoop_path(self.spark, f"{self.root}/_manifest")
        versions = sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []
        old, kept = versions[:-keep], versions[-keep:]
        live = {s.path for v in kept for s in self.manifest(v)["shards"]}
        gone = {s.path for v in old for s in self.manifest(v)["shards"]} - live
        for v in old:  # first, so that no version names a shard that isn't there
            delete(self.spark, f"{self.root}/_manifest/v{v:08d}.json")
        for path in gone:
            delete(self.spark, f"{self.root}/{path}")
        return len(gone)

    def read(self, version: int | None = None, shard_column: str | None = None) -> DataFrame:
        """The rows of a version; shard_column: the name of a column to add that says which shard a row lies in."""
        found = self.manifest(version)
        if found["schema"] is None:
            return self.spark.createDataFrame([], StructType([]))
        schema = StructType.fromJson(json.loads(found["schema"]))
        if shard_column in schema.names:
            raise ValueError(f"the rows have a column {shard_column} of their own")
        if not found["shards"]:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(shard_column, F.lit("")) if shard_column else empty
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in found["shards"]])
        if shard_column is None:
            return rows
        at = rows.metadataColumn("_metadata")  # also where the rows have a column of that name
        return rows.select("*", F.concat_ws("/", F.element_at(F.split(at["file_path"], "/"), -2), at["file_name"]).alias(shard_column))
