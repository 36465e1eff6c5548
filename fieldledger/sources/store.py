"""A field: thirteen tables on storage, with uncommitted rows on top.

Committed tables are Parquet, one folder a batch, and a manifest that names the batches. A
commit writes all its folders first and the manifest last, under a new number; readers take the
newest manifest, so they see all of a batch or none. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES


class Field:
    """The tables of one field. Without a path it lives in this session alone."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path.rstrip("/") if path else None
        self.committed: dict[str, DataFrame] = {}
        self.pending: dict[str, list[dict]] = {name: [] for name in TABLES}
        self.batches: dict[str, list[str]] = {name: [] for name in TABLES}
        self.writers: dict[str, int] = {}
        self.version = 0
        if self.path:
            self._open()

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Field:
        """A field over given DataFrames."""
        field = cls(spark)
        field.committed = {name: df.select(*TABLES[name].names) for name, df in tables.items()}
        return field

    # --- reading

    def table(self, name: str) -> DataFrame:
        """Committed and uncommitted rows."""
        schema = TABLES[name]
        fresh = self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in self.pending[name]], schema)
        if name not in self.committed:
            return fresh
        return self.committed[name].unionByName(fresh) if self.pending[name] else self.committed[name]

    def rows(self, name: str, **equal: object) -> list[dict]:
        """The rows with the given values; the committed ones are looked up by a pushed-down filter."""
        found = []
        if name in self.committed:
            df = self.committed[name]
            for column, value in equal.items():
                df = df.where(df[column] == value)
            found = [r.asDict(recursive=True) for r in df.collect()]
        return found + [dict(r) for r in self.pending[name] if all(r[c] == v for c, v in equal.items())]

    def row(self, name: str, **equal: object) -> dict | None:
        found = self.rows(name, **equal)
        return found[0] if found else None

    def subject(self, name: str, **equal: object) -> DataFrame:
        """The rows with the given values as a DataFrame."""
        rows = self.rows(name, **equal)
        schema = TABLES[name]
        return self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)

    # --- writing

    def append(self, name: str, row: dict) -> None:
        if set(row) != set(TABLES[name].names):
            raise ValueError(f"{name} has the columns {TABLES[name].names}")
        self.pending[name].append(row)

    def mark(self) -> dict[str, int]:
        return {name: len(rows) for name, rows in self.pending.items()}

    def rollback(self, mark: dict[str, int] | None = None) -> None:
        """Forgets uncommitted rows, those after the mark if there is one."""
        for name, rows in self.pending.items():
            del rows[(mark or {}).get(name, 0) :]

    def commit(self) -> int:
        """Makes the uncommitted rows part of the field, all at once."""
        changed = [name for name, rows in self.pending.items() if rows]
        if not changed:
            return self.version
        self.version += 1
        if self.path is None:
            for name in changed:
                self.committed[name] = self.table(name)
        else:
            for name in changed:
                batch = self._batch()
                schema = TABLES[name]
                self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in self.pending[name]], schema).coalesce(1).write.parquet(f"{self.path}/{name}/{batch}")
                self.batches[name].append(batch)
            self._publish()
            self._open()
        self.rollback()
        return self.version

    def commit_frames(self, once: tuple[str, int] | None = None, **frames: DataFrame) -> int:
        """Commits whole DataFrames of new rows, for batch writers.

        once names a writer and the number of its batch: a batch that the field holds already, for
        a writer that starts again sends its last one again, is not committed twice.
        """
        if once is not None:
            writer, number = once
            if number <= self.writers.get(writer, -1):
                return self.version
            self.writers[writer] = number
        if self.path is None:
            for name, df in frames.items():
                new = df.select(*TABLES[name].names)
                self.committed[name] = self.committed[name].unionByName(new) if name in self.committed else new
            return self.version
        self.version += 1
        for name, df in frames.items():
            batch = self._batch()
            df.select(*TABLES[name].names).write.parquet(f"{self.path}/{name}/{batch}")
            self.batches[name].append(batch)
        self._publish()
        self._open()
        return self.version

    # --- the manifest, through Hadoop's file systems: the folder may be in any store

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(sc._jsc.hadoopConfiguration())

    def _batch(self) -> str:
        """A folder name of this commit's own: what a broken commit leaves behind is in nobody's way."""
        return f"batch-{self.version:08d}-{uuid.uuid4().hex[:12]}"

    def _publish(self) -> None:
        at, fs = self._fs(f"{self.path}/_manifest/{self.version:08d}.json")
        draft, _ = self._fs(f"{self.path}/_manifest/.{self.version:08d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": self.version, "batches": self.batches, "writers": self.writers}), "utf-8"))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):  # somebody else committed this version
            raise RuntimeError(f"version {self.version} of {self.path} exists")

    def _open(self) -> None:
        folder, fs = self._fs(f"{self.path}/_manifest")
        if not fs.exists(folder):
            return
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return
        text = self.spark.read.text(f"{self.path}/_manifest/{names[-1]}", wholetext=True).head()[0]
        found = json.loads(text)
        self.writers = found.get("writers", {})
        self.version, self.batches = found["version"], {name: found["batches"].get(name, []) for name in TABLES}
        self.committed = {name: self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{name}/{b}" for b in batches]) for name, batches in self.batches.items() if batches}
