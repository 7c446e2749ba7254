"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D, nothing else.
BLANKS = " \t\n\x0b\f\r"
#: Rows of an Arrow batch in what ``Scratch.keep`` runs.
ARROW_ROWS = 1_000
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def others(df: DataFrame, taken: list[str]) -> list[Column]:
    """The columns of ``df`` that an operator passes through: all but those that it writes itself."""
    low = {c.lower() for c in taken}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def cut_sizes(n: Column) -> Column:
    """The root of ``n``, at least 1: with parts of that size, what costs the square of its length costs n ** 1.5 at most."""
    return F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For an array of ints (none negative) what ``combine``, a sum or maximum from 0 on, makes of all elements before each; in one row
    and without Python. Arrays that grow element by element are copied each time, so they grow in parts of the root of the
    length only."""

    def grown(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, zero, step, lambda a: a["out"])

    def whole(s: Column) -> Column:
        def parts(c: Column) -> Column:
            cut = lambda i: F.slice(s, i * c + 1, c)
            index = F.sequence(F.lit(0), F.ceil(F.size(s) / c).cast("int") - 1)
            total = F.transform(index, lambda i: F.aggregate(cut(i), F.lit(0), lambda a, x: combine(a, x)))
            return let(grown(total, F.lit(0)), lambda starts: F.flatten(F.transform(starts, lambda at, i: grown(cut(i), at))))

        return F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(cut_sizes(F.size(s)), parts))

    return let(values, whole)


_batches = threading.Lock()
_small: dict[int, list] = {}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller batches to and from Python while a block runs: whole texts come in them, and each task holds some at once.

    Blocks may overlap (several threads on one session): the first sets the session's value, the last puts it back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _batches:
        entry = _small.setdefault(id(spark), [0, spark.conf.get(key)])
        entry[0] += 1
        before = int(entry[1])
        spark.conf.set(key, str(ARROW_ROWS if before <= 0 else min(before, ARROW_ROWS)))
    try:
        yield
    finally:
        with _batches:
            entry[0] -= 1
            if not entry[0]:
                spark.conf.set(key, entry[1])
                del _small[id(spark)]


_scopes: list[list["Scratch"]] = []


@contextmanager
def released() -> Iterator[None]:
    """Removes the tables that operators wrote in the block when it ends: for callers that have stored the result by then."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for s in made:
            s.drop()


class Scratch:
    """Tables written to the folder that driver and executors share, to cut lineage.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) is a
    local one set; on a cluster without the setting this raises. Tables live as long as results may read them; ``drop``
    removes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            folder = spark.conf.get("spark.checkpoint.dir", None)
            if not folder and not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
            if not folder:
                import tempfile

                folder = tempfile.mkdtemp(prefix="gleaner-")
            sc.setCheckpointDir(folder)
        self.spark, self.root = spark, f"{sc.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        for scope in _scopes:
            scope.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back, without its lineage."""
        path = f"{self.root}/{name}"
        with _small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table of this scratch folder, or the whole folder, through Hadoop, wherever it is."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
