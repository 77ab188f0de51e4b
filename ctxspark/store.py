"""Tables as Parquet snapshots with a pointer, so a reader sees one whole version or another.

Parquet has no update: a merge writes the new rows and those old rows whose key isn't among them as the next version,
then adds a pointer with the next number. Pointers are never changed: one is written under another name and renamed, and
readers take the highest whole one, so a crash at any point leaves the version before. One writer at a time. Paths are
Hadoop paths; local ones work too."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.schema import KEYS, SCHEMAS

VERSION = 8
#: Pointers that stay beside the newest.
KEPT = 4


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs, self._path = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _read_pointer(self) -> dict:
        for n in reversed(self._pointers()):
            try:
                return json.loads(self.spark.read.text(f"{self.root}/pointers/{n}.json", wholetext=True).first()[0])
            except (ValueError, TypeError):  # cut off
                continue
        return {"version": VERSION, "tables": {}, "metadata": {}}

    def _pointers(self) -> list[int]:
        folder = self._path(f"{self.root}/pointers")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def _move_pointer(self, pointer: dict) -> None:
        have = self._pointers()
        new = self._path(f"{self.root}/pointers/next.tmp")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if not self._fs.rename(new, self._path(f"{self.root}/pointers/{max(have, default=0) + 1}.json")):
            raise OSError(f"{self.root}: another writer was first")
        for n in have[:-KEPT]:
            self._fs.delete(self._path(f"{self.root}/pointers/{n}.json"), False)

    def read(self, table: str) -> DataFrame:
        at = self._read_pointer()["tables"].get(table)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/v{at}")

    def has(self, table: str) -> bool:
        """Whether the table was ever written."""
        return table in self._read_pointer()["tables"]

    def write(self, **tables: DataFrame) -> None:
        """Replace tables, all in one step: the pointer moves once all are written."""
        pointer = self._read_pointer()
        for name, df in tables.items():
            n = pointer["tables"].get(name, 0) + 1
            cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
            df.select(*cols).write.mode("overwrite").parquet(f"{self.root}/{name}/v{n}")
            pointer["tables"][name] = n
        pointer["version"] = VERSION
        self._move_pointer(pointer)

    def merge(self, table: str, new: DataFrame, key: list[str] | None = None) -> None:
        """Upsert by key; of new rows with one key, any."""
        key = key or KEYS[table]
        new = new.dropDuplicates(key)
        self.write(**{table: self.read(table).join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)})

    def insert_ignore(self, table: str, new: DataFrame, key: list[str] | None = None) -> None:
        key = key or KEYS[table]
        old = self.read(table)
        self.write(**{table: old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)})

    def replace_children(self, table: str, parent: str, parents: DataFrame, new: DataFrame) -> None:
        """Delete the rows of parents(parent) and insert new ones."""
        self.write(**{table: self.read(table).join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)})

    def metadata(self, key: str) -> str | None:
        return self._read_pointer()["metadata"].get(key)

    def set_metadata(self, key: str, value: str | None) -> None:
        pointer = self._read_pointer()
        pointer["metadata"] = {k: v for k, v in (pointer["metadata"] | {key: value}).items() if v is not None}
        self._move_pointer(pointer)

    def needs_reparse(self) -> bool:
        """Whether an older schema wrote the tables; the next build parses everything once."""
        return self._read_pointer().get("version", 0) < VERSION
