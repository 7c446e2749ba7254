"""Git and the web as inputs (S13-S16): subprocesses and probes run on the driver or in a given function, never in an expression."""

from __future__ import annotations

import re
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed"}


def run_git(project: str, *args: str, timeout: float = 30.0) -> str | None:
    """The output of a git command, or None if it fails or takes too long."""
    try:
        got = subprocess.run(["git", "-C", project, *args], capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return got.stdout


def is_commit(text: str) -> bool:
    """whether a text can be a commit's hash."""
    return bool(re.fullmatch(r"[0-9a-fA-F]{7,40}", text))


def changed_files(spark: SparkSession, project: str, since: str, excludes: list[str] | None = None) -> DataFrame:
    """(file, change_type) between a commit and the present one; renamed files by their new path."""
    from gleaner.functions.paths import excluded

    if not is_commit(since):
        raise ValueError(f"not a commit: {since!r}")
    rows = parse_name_status(run_git(project, "diff", "--name-status", f"{since}..HEAD") or "")
    got = spark.createDataFrame(rows, "file string, change_type string")
    return got.where(~excluded(F.col("file"), excludes)) if excludes else got


def parse_name_status(text: str) -> list[tuple[str, str]]:
    out = []
    for line in text.splitlines():
        kind, *files = line.split("\t")
        if files:
            out.append((files[-1], CHANGES.get(kind[:1], "modified")))
    return out


def move(project: str, old: str, new: str) -> bool:
    """K7: moves a file so that its history goes along; whether git did."""
    return run_git(project, "mv", "--", old, new) is not None


def stage(project: str, files: list[str]) -> None:
    """K7: adds to git what was written to files."""
    for at in range(0, len(files), 500):
        run_git(project, "add", "--", *files[at : at + 500])


def head(project: str) -> dict[str, str | None]:
    """Commit and branch of a project; None where git can't tell."""
    one = lambda *a: (run_git(project, *a) or "").strip() or None
    return {"git_commit": one("rev-parse", "HEAD"), "git_branch": one("rev-parse", "--abbrev-ref", "HEAD")}


def project_name(project: str, configured: str | None = None) -> str:
    """The configured name, else the remote's, else the folder's."""
    remote = (run_git(project, "config", "--get", "remote.origin.url") or "").strip()
    return configured or re.sub(r"\.git$", "", remote.rstrip("/").rsplit("/", 1)[-1]) or project.rstrip("/").rsplit("/", 1)[-1]


def doc_health(lists: list[DataFrame], days_since: int, most_files: int = 10, most_days: int = 7) -> DataFrame:
    """One row (files, days, drift) of the changed files (file) of several lists, each counted once."""
    union = lists[0].select("file")
    for x in lists[1:]:
        union = union.unionByName(x.select("file"))
    n = F.countDistinct("file")
    return union.agg(n.alias("files"), F.lit(days_since).alias("days"), ((n >= most_files) | (F.lit(days_since) >= most_days)).alias("drift"))


def session_health(spark: SparkSession, project: str, since: str) -> DataFrame:
    """``doc_health`` of the files in commits since a moment (ISO 8601), of staged and of unstaged ones; no files where there is
    no git."""
    moment = datetime.fromisoformat(since)
    asked = (("log", f"--since={moment.isoformat(timespec='seconds')}", "--name-only", "--pretty=format:"), ("diff", "--cached", "--name-only"), ("diff", "--name-only"))
    lists = [[(line.strip(),) for line in (run_git(project, *a) or "").splitlines() if line.strip()] for a in asked]
    days = (datetime.now(timezone.utc) - moment.astimezone(timezone.utc)).days
    return doc_health([spark.createDataFrame(x, "file string") for x in lists], days)


def http_status(url: str, timeout: float = 5.0) -> int | None:
    """The status of a HEAD request, None if the host can't be reached, -1 if the request fails otherwise or isn't one of the web."""
    if not re.match(r"https?://", url, re.I):
        return -1
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as got:
            return got.status
    except urllib.error.HTTPError as e:
        return e.code
    except urllib.error.URLError:
        return None
    except Exception:  # A broken answer or URL is a finding about that URL, not an error of the report.
        return -1


def probe_assets(urls: DataFrame, prober: Callable[[str], int | None] = http_status) -> DataFrame:
    """Issues of ``urls`` (doc, src) by ``prober``, which gives the status of a URL (negative: the request failed) or None if
    it can't be reached. Each URL is probed once, on the executors; only a report that is asked for it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(seen, type=pa.string()), pa.array([prober(u) for u in seen], type=pa.int32())], names=["src", "status"])

    status = urls.select("src").distinct().mapInArrow(run, "src string, status int")
    bad = urls.join(status, "src").where("status is null or status >= 400 or status < 0")
    return bad.select(
        F.when(F.col("status").isNull(), "external_asset_unreachable").otherwise("external_asset_error").alias("type"), F.lit("warning").alias("severity"), F.col("doc").alias("file"), F.lit(1).alias("line"),
        F.concat(F.lit("External asset: "), "src", F.when(F.col("status") > 0, F.concat(F.lit(" (status "), "status", F.lit(")"))).otherwise("")).alias("message"),
    )
