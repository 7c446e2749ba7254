"""Snapshots of files, symbols and dependencies.

A snapshot is a Parquet folder of its own, never changed after it was written. ``current`` names the valid one; it is replaced by
renaming a complete file over it, so readers see the old snapshot or the new one, and a failed write leaves the old.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from contextlib import contextmanager, nullcontext
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0.0"


@contextmanager
def locked(folder: str, tries: int = 3, pause: float = 1.0):
    """K8: holds a lock file in a local folder; raises TimeoutError after ``tries`` tries."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "lock")
    for i in range(tries):
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if i + 1 == tries:
                raise TimeoutError(f"{path} is held by another process") from None
            time.sleep(pause)
    try:
        yield
    finally:
        os.close(fd)
        os.unlink(path)


class Snapshots:
    """The snapshots of one project in a folder that all executors reach (a path without scheme is local)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, kind: str) -> str:
        return f"{self.folder}/{kind}.current.json"

    def header(self, kind: str) -> dict | None:
        """What is known of the valid snapshot: version, times, counts; None if there is none or it can't be read."""
        p = self._path(self._pointer(kind))
        if not self._fs.exists(p):
            return None
        try:
            with_in = self._fs.open(p)
            data = bytes(with_in.readAllBytes())
            with_in.close()
            return json.loads(data)
        except (ValueError, UnicodeDecodeError):
            return None

    def write(self, kind: str, df: DataFrame, **header) -> dict:
        """K1, K2, K3, K8: writes a snapshot of ``df`` and makes it the valid one; creation time stays, update time is new. In a local
        folder a lock is held while the valid one is replaced, so that of two writers none reads what the other is replacing."""
        name = f"{kind}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.folder}/{name}")
        local = re.sub("^file:/+", "/", self.folder)
        with locked(local) if "://" not in local else nullcontext():
            return self._replace(kind, name, header)

    def _replace(self, kind: str, name: str, header: dict) -> dict:
        now, old = datetime.now(timezone.utc).isoformat(), self.header(kind) or {}
        info = header | {"version": VERSION, "snapshot": name, "created_at": old.get("created_at", now), "updated_at": now}
        part = self._path(f"{self.folder}/{name}.json.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(info, default=str).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, self._path(self._pointer(kind)), option)
        return info

    def read(self, kind: str) -> DataFrame | None:
        """The valid snapshot, or None."""
        info = self.header(kind)
        return self.spark.read.parquet(f"{self.folder}/{info['snapshot']}") if info else None


def read_baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of a stored baseline file whose ``files`` maps paths to checksums; a malformed file has no rows."""
    raw = spark.read.schema("files map<string,string>, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("files is not null").select(F.explode("files").alias("path", "sha256"))


def read_symbols_json(spark: SparkSession, path: str) -> DataFrame:
    """The symbols of a stored baseline file whose ``symbols`` maps names to lists of symbols; bad rows are left out."""
    one = "struct<name:string,type:string,file:string,line:int,column:int,signature:string,parent:string,doc:string>"
    raw = spark.read.schema(f"symbols map<string,array<{one}>>, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("symbols is not null").select(F.explode("symbols").alias("key", "list")).select("key", F.posexplode("list").alias("ord", "s"))
    return rows.where("s.name is not null and s.file is not null").select("s.*", "ord")


def read_dependencies_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges (doc, path) of a stored dependencies file whose ``doc_to_code`` maps documents to sources."""
    raw = spark.read.schema("doc_to_code map<string,array<string>>, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("doc_to_code is not null").select(F.explode("doc_to_code").alias("doc", "l")).select("doc", F.explode("l").alias("path"))


def newer(version: str, required: str = VERSION) -> int:
    """-1, 0 or 1 as a dotted version is before, equal to or after the required one; -1 if it is none."""
    try:
        a, b = ([int(x) for x in v.split(".")] for v in (version, required))
    except ValueError:
        return -1
    width = max(len(a), len(b))
    a, b = a + [0] * (width - len(a)), b + [0] * (width - len(b))
    return (a > b) - (a < b)


def capped(text: str, limit: int = 25_000) -> str:
    """K9: a text for display, cut at ``limit`` characters with a note."""
    note = "\n[cut]"
    return text if len(text) <= limit else text[: limit - len(note)] + note


def redacted(error: Exception, root: str) -> str:
    """An error's text without the project's place on this machine."""
    return re.sub(re.escape(root.rstrip("/")) + "/?", "<project>/", f"{type(error).__name__}: {error}")
