"""Limits and checks on what callers give, and summaries for display."""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.conventions import Conventions
from gleaner.sources.project import within  # noqa: F401  (F5, beside the other guards)

MOST_PATTERNS, LONGEST_PATTERN = 50, 512
#: Seconds an operation may take.
TIMEOUT = 60
#: Rows that reports show at most.
SHOWN = {"undocumented": 50, "duplicates": 5, "documents": 10, "links": 10}


def checked_root(path: str) -> str:
    """an existing folder's absolute path; raises ValueError for others and for paths with ``..``."""
    if ".." in path.split("/") or not os.path.isabs(path) or not os.path.isdir(path):
        raise ValueError(f"not an absolute path of a folder: {path!r}")
    return path.rstrip("/") or "/"


def checked_patterns(patterns: Iterable[str]) -> list[str]:
    """globs, not too many or too long, without repeated groups that could take exponential time."""
    got = list(patterns)
    if len(got) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    for p in got:
        if len(p) > LONGEST_PATTERN or re.search(r"\([^)]*[+*][^)]*\)[+*{]", p) or ".." in p.split("/"):
            raise ValueError(f"pattern not accepted: {p[:50]!r}")
    return got


@contextmanager
def time_limit(spark: SparkSession, seconds: float = TIMEOUT):
    """Cancels the Spark jobs of the block when its time is over."""
    group = f"limit-{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(group, "time limit", interruptOnCancel=True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def shown(df: DataFrame, what: str, *order: str | Column) -> DataFrame:
    """The first rows of a report in a stated order."""
    return df.orderBy(*order).limit(SHOWN[what])


def stamped(df: DataFrame, tool: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> DataFrame:
    """A report with what made it and when as constant columns."""
    return df.withColumn("generated_by", F.lit(tool)).withColumn("generated_at", F.lit(now().isoformat()))


def summary(rules: Conventions) -> list[str]:
    """The rules of a project as lines of text."""
    out = []
    if rules.heading_case:
        out.append(f"Headings: {rules.heading_case.replace('_', ' ')}")
    if rules.max_depth:
        out.append(f"Headings: at most level {rules.max_depth}")
    if rules.hierarchy:
        out.append("Headings: no skipped levels")
    if rules.language_tag:
        out.append("Code blocks: language named")
    if rules.alt_text:
        out.append("Images: alternative text")
    return out
