"""Persistence: snapshots of all tables as parquet, published together by a manifest.

A snapshot is written to a folder of its own; then a manifest that names it is written beside and renamed into
place. Readers see the old snapshot or the new one. Files are reached through Hadoop's file systems, so a store may
lie wherever Spark can read and write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import fields

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from loomnote.operators.changes import Tables
from loomnote.operators.graph import known_types

FORMAT_VERSION = 1
NAMES = tuple(f.name for f in fields(Tables))
#: Tables that lie sorted by a column, so that a scan for its values skips most row groups (a term asks for a range of tokens).
SORTED = {"note_token": "token"}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _manifest(self) -> dict | None:
        fs, target = self._fs(f"{self.path}/manifest.json")
        if not fs.exists(target):
            return None
        try:
            return json.loads("".join(r.value for r in self.spark.read.text(str(target)).collect()))
        except (ValueError, PySparkException, Py4JJavaError):  # damaged: as if there were none
            return None

    def save(self, tables: Tables) -> str:
        """Write a snapshot and publish it. The one before stays, for readers that have it open; older ones go."""
        before, name = self._manifest(), f"snapshot-{uuid.uuid4().hex}"
        schemas = {}
        for table in NAMES:
            df = getattr(tables, table)
            schemas[table] = df.schema.json()  # an empty table has no file that would tell
            df = df.sortWithinPartitions("notebook_id", SORTED[table]) if table in SORTED else df
            df.write.partitionBy("notebook_id").parquet(f"{self.path}/{name}/{table}")
        fs, draft = self._fs(f"{self.path}/manifest-{uuid.uuid4().hex}.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"format_version": FORMAT_VERSION, "snapshot": name, "tables": schemas}).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(draft, final, options)
        self._drop_all_but({name, (before or {}).get("snapshot")})
        return name

    def load(self) -> Tables | None:
        """The published snapshot; None if there is none, it has another format, or a table is missing: then build anew."""
        manifest = self._manifest()
        if manifest is None or manifest.get("format_version") != FORMAT_VERSION or set(manifest.get("tables", {})) != set(NAMES):
            return None
        at = f"{self.path}/{manifest['snapshot']}"
        for table in NAMES:
            fs, target = self._fs(f"{at}/{table}")
            if not fs.exists(target):
                return None
        # With a schema given, a notebook id that looks like a number is read as the text it is.
        schemas = {t: StructType.fromJson(json.loads(s)) for t, s in manifest["tables"].items()}
        read = {t: self.spark.read.schema(schemas[t]).parquet(f"{at}/{t}") for t in NAMES}
        read["edge"] = known_types(read["edge"])
        return Tables(**read)

    def delete(self) -> None:
        """Drop every snapshot and the manifest; absent ones are no error."""
        fs, target = self._fs(self.path)
        fs.delete(target, True)

    def vacuum(self) -> None:
        """Drop the snapshots that are not published."""
        self._drop_all_but({(self._manifest() or {}).get("snapshot")})

    def _drop_all_but(self, kept: set[str | None]) -> None:
        fs, root = self._fs(self.path)
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("snapshot-") and name not in kept:
                fs.delete(status.getPath(), True)
