"""Project files as DataFrames (S1-S6), configuration (S8, S9, K4, K5) and the default exclusions (F2)."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import yaml
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import paths

# What is left out of every scan. Folders stand for themselves and all in them, at any depth.
EXCLUDED_FOLDERS = (
    ".git .svn .hg .bzr __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox .nox venv .venv env .virtualenv .eggs dist build htmlcov .hypothesis node_modules .npm .yarn .pnp coverage .next .nuxt "
    ".output .turbo out vendor bin pkg target .gradle .mvn .idea .vs Debug Release x64 x86 .bundle obj packages .vscode deps .elixir_ls .dart_tool .build DerivedData .swiftpm .stack-work "
    "dist-newstyle .terraform .serverless .aws-sam .settings nbproject tmp temp logs _build .docusaurus public site .gleaner"
).split()
EXCLUDED_GLOB_FOLDERS = ("*.egg-info", "cmake-build-*", "*.xcodeproj")
EXCLUDED_FILES = (
    "*.pyc *.pyo *.pyd .coverage .pnp.js *.o *.so *.dylib *.dll *.swp *.swo *~ .DS_Store Thumbs.db desktop.ini .Spotlight-V100 .Trashes composer.lock .flutter-plugins .flutter-plugins-dependencies pubspec.lock "
    ".terraform.lock.hcl *.tfstate *.tfstate.backup docker-compose.override.yml .project .classpath *.sublime-workspace *.sublime-project *.iml *.env .env.* *.pem *.key secrets.json secrets.yml credentials.json "
    "credentials.yml *.log *.tmp *.bak *.old *.orig *.patch *.diff *.local"
).split()
CODE_ENDINGS = "py go js ts tsx jsx java rs rb php c cpp h hpp cs swift kt".split()
SOURCE_CONFIG_ENDINGS = "yaml yml json toml cfg ini".split()
MAX_FILES = 10_000


def default_excludes() -> list[str]:
    """the globs of the default exclusions."""
    folders = [*EXCLUDED_FOLDERS, *EXCLUDED_GLOB_FOLDERS]
    return [g for f in folders for g in (f"**/{f}", f"**/{f}/**")] + [f"**/{f}" for f in EXCLUDED_FILES]


def _fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path without scheme is local), and the path in it."""
    uri = re.sub("^file:/+", "file:///", uri.rstrip("/"))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below ``root``, hidden ones and those that start with an underscore included (Spark's own
    listing leaves both out, and with them every ``__init__.py``). A file that a link leads to out of the root is not listed.
    Names and sizes are listed on the driver: a project's, not a data lake's (``scan`` bounds them)."""
    where, base = _fs(root)
    found = where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    rows = [(f.path[len(base) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File]
    if isinstance(where, fs.LocalFileSystem):
        rows = [r for r in rows if within(base, r[0])]
    return spark.createDataFrame(rows, "path string, size long")


def within(root: str, path: str, depth: int = 100) -> bool:
    """whether a path stays below ``root`` once its links are followed, at most ``depth`` of them."""
    at = os.path.join(root, path)
    for _ in range(depth):
        if not os.path.islink(at):
            real = os.path.realpath(at)
            return real == os.path.realpath(root) or real.startswith(os.path.realpath(root) + os.sep)
        at = os.path.join(os.path.dirname(at), os.readlink(at))
    raise RecursionError(f"more than {depth} links from {path!r}")


def scan(
    spark: SparkSession, root: str, excludes: list[str] | None = None, gitignore: str | None = None, max_files: int | None = MAX_FILES, skip_hidden: bool = True, with_text: bool = True
) -> DataFrame:
    """The files below ``root``: path relative to it, size, sha256 of the bytes (null if they can't be read), and
    text (null where the bytes are no UTF-8).

    Names are listed on the driver, bodies read by the executors, so ``root`` must be a folder that they reach. Hidden
    components count below the root only. Exclusions are predicates on the listing; more than ``max_files`` files that pass
    raise ValueError (null: no limit).
    """
    keep = ~paths.excluded(F.col("path"), default_excludes() if excludes is None else excludes)
    if skip_hidden:
        keep = keep & ~paths.hidden(F.col("path"))
    if gitignore:
        keep = keep & ~paths.ignored(F.col("path"), paths.gitignore_rules(gitignore))
    got = listing(spark, root).where(keep)
    if max_files is not None and got.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files below {root}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _fs(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sums, texts = [], []
                for path in part.column(0).to_pylist():
                    try:
                        with where.open_input_file(f"{base}/{path}") as f:
                            body = f.read()
                    except OSError:
                        body = None
                    sums.append(None if body is None else hashlib.sha256(body).hexdigest())
                    try:
                        texts.append(body.decode() if body is not None and with_text else None)
                    except UnicodeDecodeError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sums, type=pa.string()), pa.array(texts, type=pa.string())], names=["path", "size", "sha256", "text"])

    return got.mapInArrow(read, "path string, size long, sha256 string, text string")


def markdown_files(files: DataFrame, docs_root: str = "", include_root_readme: bool = False, ordered: bool = True) -> DataFrame:
    """The markdown files below ``docs_root``, in order of their paths (unless ``ordered`` is false: for plans that go on);
    the root's readme too if asked for."""
    prefix = docs_root.strip("/") + "/" if docs_root.strip("/") else ""
    inside = F.startswith("path", F.lit(prefix)) & F.lower("path").rlike(r"\.(?:md|markdown)$")
    readme = F.lower("path") == "readme.md"
    found = files.where(inside | readme if include_root_readme else inside)
    return found.orderBy("path") if ordered else found


def source_files(files: DataFrame, docs_root: str = "docs", globs: list[str] | None = None) -> DataFrame:
    """The source files (by ``globs``, else by their endings), once each, documentation aside."""
    wanted = paths.excluded(F.col("path"), globs) if globs else paths.suffix(F.col("path")).isin(*CODE_ENDINGS, *SOURCE_CONFIG_ENDINGS)
    return files.where(wanted & ~F.startswith("path", F.lit(docs_root.strip("/") + "/"))).dropDuplicates(["path"])


def doc_index(docs: DataFrame, docs_root: str = "docs") -> DataFrame:
    """Documents with their name, path below ``docs_root`` and category; hidden ones left out."""
    rel = paths.doc_relative(F.col("path"), docs_root)
    return docs.where(~paths.hidden(F.col("path"))).select("path", paths.basename(F.col("path")).alias("name"), rel.alias("doc"), paths.doc_category(rel).alias("category"))


def load_yaml(path: str) -> dict | None:
    """A configuration file with null lists as empty ones, or None if it is missing or can't be read."""
    try:
        got = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError, UnicodeDecodeError):
        return None
    if not isinstance(got, dict):
        return None
    return got | {k: [] for k in ("exclude", "sources", "include") if k in got and got[k] is None}


def move_file(root: str, old: str, new: str, mover: Callable[[str, str, str], bool] | None = None) -> str:
    """K7: brings a file to its new place below ``root``: by ``mover`` (root, old, new) if it can, else as a copy; what was done."""
    to = Path(root, new)
    to.parent.mkdir(parents=True, exist_ok=True)
    if mover is not None and mover(root, old, new):
        return "git mv"
    shutil.copy2(Path(root, old), to)
    return "copy"


def save_yaml(path: str, values: dict, comment: str = "") -> None:
    """K4: a configuration file with a comment at its top."""
    head = "".join(f"# {line}\n" for line in comment.splitlines())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(head + yaml.safe_dump(values, sort_keys=False, allow_unicode=True), encoding="utf-8")


#: K4: what a project's configuration says where it says nothing else, and what its keys are for.
DEFAULT_CONFIG = {"docs_path": "docs", "include_root_readme": False, "exclude": [], "sources": [], "doc_mappings": {}}
CONFIG_GUIDE = """Configuration of the documentation tools
docs_path: the folder of the documents
include_root_readme: whether the readme at the root is one of them
exclude: globs of files to leave out, besides the default ones
sources: globs of source files (none: by their endings)
doc_mappings: the document of a category of files that no document refers to (cli, api, config, infrastructure, other)"""


def save_default_config(path: str, values: dict | None = None) -> bool:
    """K4: writes a project's configuration, the defaults but for ``values``, with its guide, unless there is one; whether it did."""
    if Path(path).exists():
        return False
    save_yaml(path, DEFAULT_CONFIG | {k: v for k, v in (values or {}).items() if k in DEFAULT_CONFIG}, CONFIG_GUIDE)
    return True


#: K5: the conventions that a project starts with.
DEFAULT_CONVENTIONS = {
    "style": {"headings": {"case": "sentence_case", "max_depth": 4, "hierarchy": True}, "code": {"language_tag": True}, "images": {"alt_text": True}},
    "terminology": {"avoid": [{"word": "just", "exceptions": ["just-in-time"]}, {"word": "simply", "exceptions": []}], "preferred": {}},
}


def save_default_conventions(path: str) -> bool:
    """K5: writes the default conventions unless there are some; whether it did."""
    if Path(path).exists():
        return False
    save_yaml(path, DEFAULT_CONVENTIONS, "Documentation conventions of this project")
    return True
