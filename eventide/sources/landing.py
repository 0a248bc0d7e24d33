"""Publication that is all or nothing: create-if-absent files, and batches that appear whole.

A batch is written to a staging folder that readers don't see, checked there, and appears by one rename. Its id is claimed before by a
file that only one writer can create, so two writers never land one id, and what a killed writer leaves is a
claim and a staging folder, never rows. Both need a file system whose renames are atomic and don't replace what is there (HDFS; a local or mounted
disk, where a hard link takes the rename's place).
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLAIMS, STAGING, RECORD = "_claims", "_staging", "_landed.json"


class Folder:
    """A folder of the cluster's file system, from the driver: small files, renames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, sorted; nothing if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that nobody else writes."""
        stream = self._fs.create(self._at(name), True)
        stream.write(text.encode())
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file with all of its text, unless it is there: of several writers exactly one gets True."""
        part = f"{os.path.dirname(name) or '.'}/.{uuid.uuid4().hex}"
        self.put(part, text)
        try:
            if self._fs.getUri().getScheme() == "file":
                real, target = (self._at(x).toUri().getPath() for x in (part, name))
                try:
                    os.link(real, target)
                except FileExistsError:
                    return False
                return True
            return not self.exists(name) and self._fs.rename(self._at(part), self._at(name))
        finally:
            self.delete(part)

    def rename(self, name: str, to: str) -> None:
        if self.exists(to) or not self._fs.rename(self._at(name), self._at(to)):
            raise FileExistsError(f"{self.path}/{to}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Landed:
    """What a batch's record says; it appears with the batch."""

    batch_id: int
    rows: int
    duplicates: int
    shards: int | None
    schema: str
    note: str


class Landing:
    """The batches of one table: folders batch_id=N under `path`, which any reader of Parquet sees once they are whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def ids(self) -> list[int]:
        """The ids that are published."""
        return sorted(int(n.removeprefix("batch_id=")) for n in self.folder.names() if n.startswith("batch_id="))

    def record(self, batch_id: int) -> Landed:
        return Landed(**json.loads(self.folder.text(f"batch_id={batch_id}/{RECORD}")))

    def pending(self) -> list[int]:
        """Ids that a writer has claimed and not published: at work, or killed."""
        return sorted(int(n) for n in self.folder.names(CLAIMS) if n.isdigit() and int(n) not in self.ids())

    def recover(self, batch_id: int) -> None:
        """Free the id of a killed writer and delete what it staged; only when it is known to be dead."""
        for name in self.folder.names(STAGING):
            if name.startswith(f"{batch_id}-"):
                self.folder.delete(f"{STAGING}/{name}")
        self.folder.delete(f"{CLAIMS}/{batch_id}")

    def land(
        self, df: DataFrame, batch_id: int, *, schema: StructType | None = None, expect: int | None = None, shard: str | None = None, expect_shards: int | None = None, distinct: bool = False,
        unique: list[str] | None = None, note: str = "",
    ) -> Landed:
        """Publish df as a batch, or raise and leave nothing.

        distinct: rows equal in every column are one row (with a shard column, this is by shard). Checked on what was staged: the schema (the given one, or that of the table's last batch),
        the number of rows (`expect`), the number of shards, and that no two rows agree in `unique`.
        """
        folder = self.folder
        if not folder.create(f"{CLAIMS}/{batch_id}", uuid.uuid4().hex):
            raise ValueError(f"batch {batch_id} is being written by another, or was left by one")
        staged = f"{STAGING}/{batch_id}-{uuid.uuid4().hex}"
        try:
            ids = self.ids()
            if batch_id in ids:
                raise ValueError(f"batch {batch_id} exists: batches are append-only")
            df = df.drop("batch_id")
            seen = Observation()
            rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
            if distinct:
                rows = rows.dropDuplicates()
            rows.write.parquet(f"{self.path}/{staged}")
            record = self._check(df, f"{self.path}/{staged}", seen.get["n"], batch_id, ids, schema, expect, shard, expect_shards, unique, note)
            folder.put(f"{staged}/{RECORD}", json.dumps(asdict(record), sort_keys=True))
            folder.rename(staged, f"batch_id={batch_id}")
        except Exception:
            folder.delete(staged)
            folder.delete(f"{CLAIMS}/{batch_id}")
            raise
        folder.delete(f"{CLAIMS}/{batch_id}")
        return record

    def _check(self, df: DataFrame, at: str, n_in: int, batch_id: int, ids: list[int], schema, expect, shard, expect_shards, unique, note) -> Landed:
        have = df.schema.simpleString()
        want = schema.simpleString() if schema is not None else self.record(ids[-1]).schema if ids and self.folder.exists(f"batch_id={ids[-1]}/{RECORD}") else have
        if have != want:
            raise ValueError(f"batch {batch_id} has columns {have}, the table has {want}")
        staged = self.spark.read.schema(df.schema).parquet(at)
        counts = staged.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(shard) if shard else F.lit(None).cast("long")).alias("shards")).first()
        if expect is not None and counts["n"] != expect:
            raise ValueError(f"batch {batch_id} has {counts['n']} rows, expected {expect}")
        if expect_shards is not None and counts["shards"] != expect_shards:
            raise ValueError(f"batch {batch_id} has {counts['shards']} shards, expected {expect_shards}")
        if unique:
            twice = staged.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
            if twice:
                raise ValueError(f"batch {batch_id} holds {twice[0].asDict()} more than once")
        return Landed(batch_id, counts["n"], n_in - counts["n"], counts["shards"], have, note)
