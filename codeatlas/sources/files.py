"""Directory scans and archives as DataFrames of files."""

from __future__ import annotations

import io
import os
import tarfile
from collections import deque
from collections.abc import Sequence
from posixpath import normpath
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import scratch
from ..functions import scalars


def validate_path(path: str, base: str | None = None) -> str:
    """The real path; raises if it doesn't exist or lies outside base."""
    real = os.path.realpath(path)
    if base is not None and os.path.commonpath([real, os.path.realpath(base)]) != os.path.realpath(base):
        raise ValueError(f"Path traversal detected: {path} escapes {base}")
    if not os.path.exists(real):
        raise ValueError(f"Path does not exist: {real}")
    return real


def keep_path(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """files (path, size_bytes) that may be source text by path and size: of a known language, not ignored, hidden or large."""
    path = F.col("path")
    out = files.withColumn("language", scalars.language_of_path(path)).where(F.col("language").isNotNull() & ~scalars.hidden_directory(path) & (F.col("size_bytes") <= K.MAX_FILE_BYTES))
    out = out.where(~scalars.ignored(path, [*K.IGNORED, *exclude])).where(~scalars.ignored(path, list(ignore)))
    return out.where(scalars.ignored(path, list(include))) if include else out


def keep_source(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """files (path, content, size_bytes) that are source text, by content, too."""
    return keep_path(files, include, exclude, ignore).where(~scalars.is_binary(F.col("path"), F.col("content")))


def finish(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"), "language", F.col("size_bytes").cast("long").alias("size_bytes"), "content")


def list_files(spark: SparkSession, root: str, share: int = 64) -> DataFrame:
    """path (relative), size_bytes of all files below a folder.

    Tasks list folders in rounds and keep a table of what they found: a task goes down from a folder until it has listed
    `share` of them, and leaves the folders below to the next round, which deals them out anew. So wide trees spread, deep
    ones take few rounds, and the driver sees only how many folders are left. Spark's own readers leave out names that begin
    with `_`, such as `__init__.py`.
    """
    at, k = scratch.folder(spark), 0
    ddl = "path string, size_bytes long, left boolean"
    schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("left", pa.bool_())])

    def run(batches):
        store, base = _store(root)
        rows = []
        for b in batches:
            for folder in b.column("path").to_pylist():
                todo, listed = deque([folder]), 0
                while todo and listed < share:
                    here = todo.popleft()
                    listed += 1
                    for i in store.get_file_info(fs.FileSelector(f"{base}/{here}" if here else base)):
                        inner = i.path[len(base) + 1 :]
                        if i.type == fs.FileType.Directory:
                            todo.append(inner)
                        elif i.type == fs.FileType.File:
                            rows.append((inner, i.size, False))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                rows += [(f, None, True) for f in todo]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    folders, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = scratch.save(folders.mapInArrow(run, ddl), f"{at}-{k}")
        files = found.where("NOT left").select("path", "size_bytes")
        out = files if out is None else out.unionByName(files)
        left = found.where("left").select("path")
        n = left.count()
        if not n:
            return out
        folders, k = left.repartition(min(n, 10_000)), k + 1


def read_content(files: DataFrame, root: str) -> DataFrame:
    """files with the content of each path; null where it can't be read."""

    def run(batches):
        store, base = _store(root)
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                try:
                    with store.open_input_stream(f"{base}/{row.column('path')[0].as_py()}") as f:
                        body = f.read()
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body], pa.binary())], names=[*row.schema.names, "content"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInArrow(run, f"{ddl}, content binary")


def _store(root: str):
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{quote(os.path.abspath(root))}")


def scan_directory(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """path (relative), sha256, language, size_bytes, content of the source files below a folder, or of those in `only` (path); hash and content are null where a file can't be read. A .gitignore at its top counts."""
    store, base = _store(root)
    rules: list[str] = []
    if store.get_file_info(f"{base}/.gitignore").type == fs.FileType.File:
        with store.open_input_stream(f"{base}/.gitignore") as f:
            rules = f.read().decode("utf-8", "replace").splitlines()
    kept = keep_path(list_files(spark, root), include, exclude, rules)
    kept = (kept if only is None else kept.join(only, "path", "left_semi")).repartition("path")
    full = read_content(kept, root)
    return finish(full.where(F.col("content").isNull() | ~scalars.is_binary(F.col("path"), F.col("content"))))


def untar(archives: DataFrame) -> DataFrame:
    """path, size_bytes, content of the files in tar archives (column content), without the top folder; links and unsafe paths are left out."""

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for m in tar:
                        inner = m.name.partition("/")[2]
                        if not m.isfile() or not inner or normpath(inner).startswith(("..", "/")) or ".." in inner.split("/"):
                            continue
                        body = tar.extractfile(m).read()
                        yield pa.RecordBatch.from_arrays([pa.array([inner]), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())], names=["path", "size_bytes", "content"])

    return archives.select("content").mapInArrow(run, "path string, size_bytes long, content binary")


def scan_archive(spark: SparkSession, path: str, sparse: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """The source files of a downloaded repository archive; with `sparse`, those under its prefixes."""
    files = untar(spark.read.format("binaryFile").load(path))
    if sparse:
        files = files.where(scalars.has_prefix(F.col("path"), list(sparse)))
    return finish(keep_source(files, include, exclude))
