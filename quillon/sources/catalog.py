"""What a database holds: tables, indexes, counters and the files of each table.

A state is a value: statements make a new one from the old, and a commit publishes it
as the next numbered manifest.  Parts are Parquet folders that never change; columns
are stored under ids, so names may differ in case only.
"""

from __future__ import annotations

import base64
import copy
import datetime
import json
import math
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.errors import Exists, LimitExceeded, NotFound
from quillon.functions import bridge as B
from quillon.plans.compile import Relation
from quillon.sources.files import Files

#: So many parts of like size are merged into one; files of a merged part have about so many rows.
FAN_IN, ROWS_PER_FILE = 8, 1_000_000
MAX_NAME, MAX_COLUMNS, MAX_INDEXES = 255, 1024, 64


@dataclass
class Column:
    name: str
    type: str
    id: str
    nullable: bool = True
    default: str | None = None  # printed constant, or CURRENT_TIMESTAMP
    fill: Any = None  # what rows older than the column read


@dataclass
class Part:
    path: str
    columns: list[str]  # ids
    rows: int
    digest: str | None = None  # sum of the hashes of all rows

    @property
    def name(self) -> str:
        return self.path.split("/")[1]


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: list[str]
    hidden: bool = False  # the first column is a hidden rowid
    checks: list[str] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    next_id: int = 0

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def visible(self) -> list[Column]:
        return self.columns[1:] if self.hidden else self.columns

    def add(self, name: str, type: str, **more) -> Column:
        c = Column(name, type, f"f{self.next_id}", **more)
        self.next_id += 1
        self.columns.append(c)
        return c


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False


@dataclass
class State:
    version: int = 0
    schema_version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)

    def copy(self) -> State:
        return copy.deepcopy(self)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise NotFound(f"no such table: {name}")
        return self.tables[name]

    def free_name(self, name: str, kind: str) -> None:
        if not name or len(name.encode()) > MAX_NAME:
            raise LimitExceeded(f"a name has 1 to {MAX_NAME} bytes")
        if name in self.tables or name in self.indexes:
            raise Exists(f"{kind} {name}: the name is taken")

    def uniques(self, table: str) -> list[tuple[str, list[str]]]:
        """(what, columns) of the primary key and the unique indexes of a table."""
        t = self.tables[table]
        return [("primary key", t.key)] + [(f"index {i.name}", i.columns) for i in self.indexes.values() if i.table == table and i.unique]

    def dump(self) -> str:
        return json.dumps(asdict(self), default=_dump, indent=0)

    @staticmethod
    def load(text: str) -> State:
        d = json.loads(text, object_hook=_load)
        tables = {n: Table(t["name"], [Column(**c) for c in t["columns"]], t["key"], t["hidden"], t["checks"], [Part(**p) for p in t["parts"]], t["next_id"]) for n, t in d["tables"].items()}
        return State(d["version"], d["schema_version"], tables, {n: Index(**i) for n, i in d["indexes"].items()}, d["counters"])


def _dump(v):
    if isinstance(v, bytes | bytearray):
        return {"_blob": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, datetime.datetime):
        return {"_time": v.isoformat()}
    raise TypeError(v)


def _load(d):
    if "_blob" in d:
        return base64.b64decode(d["_blob"])
    if "_time" in d:
        return datetime.datetime.fromisoformat(d["_time"])
    return d


def _digest(ids: list[str]):
    return F.sum(F.xxhash64(*[F.col(i) for i in ids]).cast("decimal(38,0)"))


class Storage:
    """Parts and manifests below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def schema(self, t: Table, ids: list[str] | None = None) -> StructType:
        kinds = {c.id: B.SPARK[c.type] for c in t.columns}
        ids = [c.id for c in t.columns] if ids is None else ids
        return StructType.fromDDL(", ".join(f"{i} {kinds[i]}" for i in ids)) if ids else StructType()

    def rows(self, t: Table, parts: list[Part] | None = None, marked: bool = False) -> DataFrame:
        """All rows, or those of some parts, columns named by their ids; marked: and the part's name as _part."""
        parts = t.parts if parts is None else parts
        if not parts:
            empty = self.spark.createDataFrame([], self.schema(t))
            return empty.withColumn("_part", F.lit("")) if marked else empty
        groups: dict[tuple[str, ...], list[str]] = {}
        for p in parts:
            groups.setdefault(tuple(p.columns), []).append(f"{self.files.root}/{p.path}")
        out = None
        for ids, paths in groups.items():
            df = self.spark.read.schema(self.schema(t, list(ids))).parquet(*paths)
            mark = [F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_part")] if marked else []
            df = df.select(*[F.col(c.id) if c.id in ids else B.literal(c.fill, c.type).alias(c.id) for c in t.columns], *mark)
            out = df if out is None else out.unionByName(df)
        return out

    def write(self, t: Table, df: DataFrame) -> Part:
        """A new part; its files are sorted by key, so that a key's bounds skip most row groups, and its rows are counted and hashed as they pass."""
        path, ids = f"data/{uuid.uuid4().hex}", [c.id for c in t.columns]
        key = [t.column(n).id for n in t.key]
        rows = df.select(*[F.col(c.id).cast(B.SPARK[c.type]) for c in t.columns]).sortWithinPartitions(*key)
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n"), _digest(ids).alias("d")).write.parquet(f"{self.files.root}/{path}")
        got = seen.get
        return Part(path, ids, got.get("n", 0), str(got["d"]) if got.get("d") is not None else None)

    def found(self, p: Part, t: Table) -> tuple[int, str | None]:
        """Rows and digest of a part as it is now; every value is read, and pages are held against their checksums."""
        reader = self.spark.read.schema(self.schema(t, p.columns)).option("parquet.page.verify-checksum.enabled", "true")
        n, d = reader.parquet(f"{self.files.root}/{p.path}").agg(F.count(F.lit(1)), _digest(p.columns)).first()
        return n, str(d) if d is not None else None

    def replace(self, t: Table, old: set[str], new: Part | None) -> None:
        """Put one part in the place of others; without rows it isn't kept."""
        t.parts = [p for p in t.parts if p.name not in old] + ([new] if new is not None and new.rows else [])

    def merge(self, t: Table, parts: list[Part]) -> None:
        """Make one part of several, its files in ranges of the key."""
        df, n = self.rows(t, parts), sum(p.rows for p in parts)
        files = -(-n // ROWS_PER_FILE)
        df = df.repartitionByRange(files, *[F.col(t.column(k).id) for k in t.key]) if files > 1 else df.coalesce(1)
        self.replace(t, {p.name for p in parts}, self.write(t, df))

    def tidy(self, t: Table) -> None:
        """Merge parts of like size where there are FAN_IN of them, so that n writes leave some FAN_IN * log n parts."""
        while True:
            tiers: dict[int, list[Part]] = {}
            for p in t.parts:
                tiers.setdefault(int(math.log(max(p.rows, 1), FAN_IN)), []).append(p)
            due = next((ps for _, ps in sorted(tiers.items()) if len(ps) >= FAN_IN), None)
            if due is None:
                return
            self.merge(t, due)

    def relation(self, t: Table) -> Relation:
        return Relation(self.rows(t), [(c.name, c.type) for c in t.columns], int(t.hidden), list(t.key))

    def last(self) -> int:
        return max((int(n[1:-5]) for n in self.files.names("_manifest") if n.startswith("v") and n.endswith(".json")), default=-1)

    def state(self, version: int | None = None) -> State:
        return State.load(self.files.read(f"_manifest/v{self.last() if version is None else version:08d}.json"))

    def publish(self, state: State) -> bool:
        return self.files.publish(f"_manifest/v{state.version:08d}.json", state.dump())
