"""Small helpers on any Hadoop file system, and tables kept in the shared folder."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as fs_
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A side of at most this many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut, sizes are known, any executor may be lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(stashed: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a written table whose row count was checked; otherwise leave the join to shuffle."""
    n = stashed.limit(rows + 1).count()
    return F.broadcast(stashed) if n <= rows else stashed.hint("merge")


def file_digests(spark: SparkSession, paths: DataFrame, part: int = 8 << 20) -> DataFrame:
    """path, bytes, sha256, rows (null: no Parquet) of files named in a column ``path``; contents stream through the executors in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                fs, at = arrow_fs(path)
                digest, size, rows = hashlib.sha256(), 0, None
                with fs.open_input_file(at) as f:
                    while data := f.read(part):
                        digest.update(data)
                        size += len(data)
                    if at.endswith(".parquet"):
                        f.seek(0)
                        rows = pq.ParquetFile(f).metadata.num_rows
                found.append((path, size, digest.hexdigest(), rows))
            yield pd.DataFrame(found, columns=["path", "bytes", "sha256", "rows"]).astype({"rows": "Int64"})

    return paths.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, "path string, bytes bigint, sha256 string, rows bigint")


def arrow_fs(path: str):
    """A pyarrow file system and the path on it; file:/x and plain paths are local."""
    if path.startswith("file:"):
        return fs_.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs_.FileSystem.from_uri(path) if "://" in path else (fs_.LocalFileSystem(), path)


class ConcurrentWriteError(RuntimeError):
    """Another writer published first; nothing was changed, and the work can be done again."""


class HadoopFiles:
    """List, read, write, rename and delete through Hadoop's FileSystem, so that any mounted scheme works."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str, overwrite: bool = False) -> None:
        stream = self._fs.create(self._path(path), overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def create_exclusive(self, path: str, text: str = "") -> bool:
        """Create a file that must not exist; False if it does. Used for locks."""
        if self.exists(path):
            return False
        try:
            self.write_text(path, text)
            return True
        except Exception:
            return False

    def rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> bool:
        return bool(self._fs.delete(self._path(path), True))

    def delete_empty(self, path: str) -> None:
        """Delete a folder that holds nothing; leave it otherwise."""
        try:
            self._fs.delete(self._path(path), False)
        except Exception:
            pass

    def list(self, path: str, recursive: bool = False) -> list[tuple[str, int, int]]:
        """(path, bytes, modification time in ms) of files below path."""
        if not self.exists(path):
            return []
        out, it = [], self._fs.listFiles(self._path(path), recursive)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def directories(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())

    def publish_new(self, path: str, value: Any) -> bool:
        """Atomic and exclusive: the complete file appears under a name that is free, or nothing does (False)."""
        side = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        self.write_text(side, json.dumps(value, indent=2, sort_keys=True, default=str))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri())
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
        try:
            context.rename(self._path(side), self._path(path), options)
            return True
        except Exception:
            self.delete(side)
            if self.exists(path):
                return False
            raise

    def publish_json(self, path: str, value: Any) -> None:
        """Atomic: write beside the target, then rename over it."""
        side = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        self.write_text(side, json.dumps(value, indent=2, sort_keys=True, default=str))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri())
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context.rename(self._path(side), self._path(path), options)


class Versions:
    """One JSON value under ``root`` that several writers may replace: each version is a new file, and the one that is a version behind is told so."""

    def __init__(self, files: HadoopFiles, root: str, keep: int = 3):
        self.files, self.root, self.keep = files, root.rstrip("/"), keep

    def _all(self) -> list[tuple[int, str]]:
        names = [(p.rsplit("/", 1)[1], p) for p, _, _ in self.files.list(self.root)]
        return sorted((int(n[8:20]), p) for n, p in names if n.startswith("version-") and n.endswith(".json") and n[8:20].isdigit())

    def read(self) -> tuple[int, Any]:
        """(number, value) of the current version; (0, None) before the first."""
        held = self._all()
        return (held[-1][0], json.loads(self.files.read_text(held[-1][1]))) if held else (0, None)

    def replace(self, number: int, value: Any) -> None:
        """Publish the version after ``number``; ConcurrentWriteError if another writer was first."""
        if not self.files.publish_new(f"{self.root}/version-{number + 1:012d}.json", value):
            raise ConcurrentWriteError(self.root)
        for n, p in self._all():
            if n <= number + 1 - self.keep:
                self.files.delete(p)


def publish_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, keep: int = 2) -> DataFrame:
    """Write df as the next version of the table at ``path`` and make it current by one new file; ``check`` may refuse it before.

    A reader finds the version before or this one, never none; versions older than
    the last ``keep`` are deleted.
    """
    spark = df.sparkSession
    files = HadoopFiles(spark, path)
    versions = Versions(files, f"{path}/_versions", keep)
    number, old = versions.read()
    name = f"v={number + 1:06d}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    try:
        if check:
            check(written)
        kept = [name, *(old or {"folders": []})["folders"]]
        versions.replace(number, {"folders": kept[:keep]})
    except BaseException:
        files.delete(f"{path}/{name}")
        files.delete_empty(path)
        raise
    for gone in kept[keep:]:
        files.delete(f"{path}/{gone}")
    return written


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table, or the folder itself where no versions were published."""
    _, held = Versions(HadoopFiles(spark, path), f"{path}/_versions").read()
    return spark.read.parquet(f"{path}/{held['folders'][0]}" if held else path)


class PartitionLog:
    """Which files of a partition count, for partitions that were compacted.

    Files named ``compact-<id>-…`` count if their id was published, all others unless
    they were retired. One new version changes both at once, so no live folder is moved.
    """

    def __init__(self, files: HadoopFiles, root: str, dataset: str):
        self.files, self.root, self.dataset = files, f"{root}/metadata/partition_log/{dataset}", dataset

    def _versions(self, partition: str) -> Versions:
        return Versions(self.files, f"{self.root}/{partition.replace('/', '--')}")

    def compacted(self) -> list[str]:
        """Partitions (year=…/month=…) that have a log."""
        return [d.rsplit("/", 1)[1].replace("--", "/") for d in self.files.directories(self.root)]

    def read(self, partition: str) -> tuple[int, dict]:
        number, held = self._versions(partition).read()
        return number, held or {"retired": [], "published": []}

    def open(self, partition: str) -> int:
        """The current version's number; from the first one on, readers ask the log which files count."""
        number, _ = self.read(partition)
        if number == 0:
            self._versions(partition).replace(0, {"retired": [], "published": []})
        return max(number, 1)

    def live(self, partition: str, paths: list[str]) -> list[str]:
        _, held = self.read(partition)
        retired, known = set(held["retired"]), set(held["published"])
        names = [(p, p.rsplit("/", 1)[1]) for p in paths]
        return [p for p, n in names if n not in retired and (not n.startswith("compact-") or n.removeprefix("compact-").rsplit("-", 1)[0] in known)]

    def swap(self, partition: str, number: int, retired: list[str], compaction: str) -> None:
        _, held = self.read(partition)
        self._versions(partition).replace(number, {"retired": sorted({*held["retired"], *retired}), "published": sorted({*held["published"], compaction})})
