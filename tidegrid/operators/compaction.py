"""Far too many small files: consolidation by copying encoded blocks.

``compact_files`` works on folders of real Parquet files: footers are read once,
encoded column blocks are copied as bytes from the small files to the large ones
while both are open, the new footers are written and validated (schema, block
counts, row totals, places of the blocks). Only files that hold a surplus copy of a
record are decoded. ``compact_fragments`` does the same for a table that lists the
records file by file: records are encoded once, in blocks, and never decoded.

Scale: files of a folder are spread over bins by a hash of their name, as many as
the folder's total asks for, so a folder with a third of all data is many tasks of
one target size each. Contents never pass through the driver or a shuffle in
``compact_files``; in ``compact_fragments`` the rows are shuffled once. Memory of a
task holds footers and one piece of a block.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import lower_key, trim_key, upper_key
from ..session import python_tasks
from ..sources.storage import HadoopFiles, arrow_fs, scratch, small_side, stash
from .latest import keep_latest
from .parquet_blocks import BlockCopier, BlockMismatch, FooterReader, Merged, footer_bytes

TARGET_BYTES = 128 << 20
#: Rows of one block at most, and of one bin of a table-borne folder.
BLOCK_ROWS, BIN_ROWS = 50_000, 500_000
RECORD = ["symbol", "date", "source", "close", "volume", "source_record_id", "ingested_at"]
KEY = ["symbol", "date", "source"]


def clean_fragments(raw: DataFrame) -> DataFrame:
    """Cleaned fragment rows; other columns are left out."""
    return raw.select(
        "compaction_id",
        F.lower(F.trim("file_role")).alias("file_role"),
        "file_name",
        "dataset",
        "partition_path",
        upper_key("symbol").alias("symbol"),
        F.col("date").cast("date").alias("date"),
        lower_key("source").alias("source"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("bigint").alias("volume"),
        trim_key("source_record_id").alias("source_record_id"),
        F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    )


def _encode(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    pq.write_table(table, sink, compression="zstd", write_statistics=False, use_dictionary=False, store_schema=False)
    return sink.getvalue()


class _File:
    """A file on any mounted file system that is read by place."""

    def __init__(self, path: str):
        fs, at = arrow_fs(path)
        self.handle = fs.open_input_file(at)

    def size(self) -> int:
        return self.handle.size()

    def read_at(self, n: int, at: int) -> bytes:
        return self.handle.read_at(n, at)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()


@contextmanager
def _new_file(folder: str) -> Iterator[tuple[str, Any]]:
    """The path and the stream of a new file in the folder."""
    path = f"{folder}/part-{uuid.uuid4().hex}.parquet"
    fs, at = arrow_fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as stream:
        yield path, stream


def _check_written(path: str, made: Merged) -> None:
    """The footer of the written file is the one that was validated."""
    with _File(path) as f:
        raw, _ = footer_bytes(f)
        if f.size() != made.size or raw != made.footer:
            raise BlockMismatch("the written file doesn't hold what was copied")


def _spread(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``bin``: 0, or a hash of the file and record for groups of more than BIN_ROWS rows."""
    counted = rows.groupBy(*group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > BIN_ROWS)
    large = stash(counted.select(*[F.col(g).alias(f"_{g}") for g in group], F.ceil(F.col("_rows") / BIN_ROWS).cast("int").alias("_bins")), "large-groups")
    on = None
    for g in group:
        same = F.col(g).eqNullSafe(F.col(f"_{g}"))
        on = same if on is None else on & same
    joined = rows.join(small_side(large), on, "left")
    return joined.withColumn("bin", F.when(F.col("_bins").isNull(), 0).otherwise(F.pmod(F.xxhash64("file_name", "symbol", "date"), F.col("_bins"))).cast("int")).drop("_bins", *[f"_{g}" for g in group])


def compact_fragments(rows: DataFrame, group: Sequence[str], into: str | None = None) -> DataFrame:
    """What the compaction of each group makes: group columns, bin, path, files, blocks, file_rows, file_bytes, one row per new file.

    rows: group columns, file_name and RECORD columns. The records of a bin, file
    after file, are encoded in blocks of at most BLOCK_ROWS; the blocks are copied into
    one file, whose footer gives the figures after it was validated. With ``into``, the
    file is written to that folder and validated as it lies there (path null
    otherwise). Each evaluation writes anew, so the caller writes the result down.
    """
    spread = _spread(rows, group)
    work = spread.select(*group, "bin", F.xxhash64(*group, "bin").alias("_g"), F.xxhash64("file_name").alias("_f"), *RECORD)
    arranged = work.repartition(python_tasks(rows.sparkSession), *group, "bin").sortWithinPartitions("_g", *group, "bin", "_f")
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    named = [*group, "bin"]
    figures = ("files", "blocks", "file_rows", "file_bytes")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in named), "path string", *(f"{c} bigint" for c in figures)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FooterReader()
        label: dict = {}
        blocks: list[bytes] = []
        current, pending, held, files, last = None, [], 0, 0, None

        def flush_block() -> None:
            nonlocal pending, held
            if pending:
                blocks.append(_encode(pa.Table.from_batches(pending)))
                pending, held = [], 0

        def finish() -> pa.RecordBatch:
            flush_block()
            path = None
            if into:
                with _new_file(into) as (path, stream):
                    copier = BlockCopier(stream, reader)
                    for b in blocks:
                        copier.add(b)
                    made = copier.finish()
                _check_written(path, made)
            else:
                copier = BlockCopier(None, reader)
                for b in blocks:
                    copier.add(b)
                made = copier.finish()
            blocks.clear()
            columns = {c: pa.array([label[c].as_py()], label[c].type) for c in named} | {"path": pa.array([path], pa.string())}
            columns |= {c: pa.array([v], pa.int64()) for c, v in zip(figures, (files, made.blocks, made.rows, made.size))}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, f = batch.column("_g").to_numpy(), batch.column("_f").to_numpy()
            records = batch.select(RECORD)
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(edges, edges[1:]):
                if current is None or int(g[a]) != current:
                    if current is not None:
                        yield finish()
                    current, files, last = int(g[a]), 0, None
                    label = {c: batch.column(c)[a] for c in named}
                files += int(np.count_nonzero(f[a + 1 : b] != f[a : b - 1])) + (last is None or int(f[a]) != last)
                last = int(f[b - 1])
                for c in range(a, b, BLOCK_ROWS):
                    n = min(BLOCK_ROWS, b - c)
                    if held + n > BLOCK_ROWS:
                        flush_block()
                    pending.append(records.slice(c, n))
                    held += n
        if current is not None:
            yield finish()

    return arranged.mapInArrow(run, schema)


def counts_before(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """files and rows per group, counting each file once."""
    per_file = rows.groupBy(*group, "file_name").agg(F.count("*").alias("_n"))
    return per_file.groupBy(*group).agg(F.count("*").alias("files"), F.sum("_n").alias("rows"))


def winners(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each record of a group once: the last ingested row per cleaned key."""
    return keep_latest(rows, [*group, *KEY], ["ingested_at", "source_record_id"], [*group, *KEY, "close", "volume", "source_record_id", "ingested_at", "file_name"])


def compact_waiting(fragments: DataFrame, target: str | None = None) -> DataFrame:
    """Compacts the fragments that wait (no compaction_id); a CompactionResult with the new files' paths per dataset and partition.

    The new files hold each record once. They are written to a staging folder,
    validated and renamed to ``target``, by default a fresh folder in the shared
    folder; ``target`` must not exist. Null keys are keys; fragments with null file
    names are one file; an empty table gives no rows.
    """
    spark = fragments.sparkSession
    target = (target or scratch(spark, "compacted")).rstrip("/")
    files = HadoopFiles(spark, target)
    if files.exists(target):
        raise FileExistsError(target)
    staging = f"{target}/_staging-{uuid.uuid4().hex[:12]}"
    group = ["dataset", "partition_path"]
    rows = clean_fragments(fragments).where("compaction_id is null and file_role = 'input'")
    before = counts_before(rows, group)
    once = stash(winners(rows, group), "once")
    made = stash(compact_fragments(once, group, staging), "compaction")
    written = made.select(*group, "file_rows").unionByName(once.groupBy(*group).agg((-F.count("*")).alias("file_rows")))
    if written.groupBy(*group).agg(F.sum("file_rows").alias("more")).where("more <> 0").limit(1).count():
        raise BlockMismatch("the written files don't hold each record once; nothing was published")
    for (path,) in made.select("path").toLocalIterator():  # few: one per output file
        files.rename(path, f"{target}/{path.rsplit('/', 1)[1]}")
    files.delete(staging)  # and what failed tasks left there
    named = made.withColumn("path", F.concat(F.lit(f"{target}/"), F.substring_index("path", "/", -1)))
    after = named.groupBy(*group).agg(F.count("*").alias("files_after"), F.sum("blocks").alias("blocks"), F.sum("file_rows").alias("rows_after"), F.sum("file_bytes").alias("bytes_after"), F.sort_array(F.collect_list("path")).alias("paths"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"b.{g}").eqNullSafe(F.col(f"a.{g}"))
    return before.alias("b").join(after.alias("a"), same).select(
        *[f"b.{g}" for g in group], F.col("files").alias("files_before"), "files_after", F.col("rows").alias("rows_before"), "rows_after",
        (F.col("rows") - F.col("rows_after")).alias("duplicate_rows_removed"), "blocks", "bytes_after", F.lit(True).alias("validated"), "paths",
    )


def wrong_compactions(fragments: DataFrame, log: DataFrame) -> DataFrame:
    """compaction_id of logged compactions that are wrong: each is done again from its inputs and compared.

    The new files' footers give the rows a right compaction has; the log's rows_after
    must be those, its four counts what the fragments hold, and the records that went
    into the new files (key, close, volume; null equals null) those of the recorded
    outputs. A logged compaction without fragments is wrong
    unless its counts are 0.
    """
    group = ["compaction_id"]
    rows = clean_fragments(fragments).where("compaction_id is not null")
    once = stash(winners(rows.where("file_role = 'input'"), group), "once")
    again = compact_fragments(once, group).groupBy(*group).agg(F.sum("file_rows").alias("made"))
    sides = once.select(*group, *KEY, "close", "volume", F.lit(1).alias("right"), F.lit(0).alias("given")).unionByName(
        rows.where("file_role = 'output'").select(*group, *KEY, "close", "volume", F.lit(0).alias("right"), F.lit(1).alias("given"))
    )
    value = F.struct("close", "volume")
    per_key = sides.groupBy(*group, *KEY).agg(F.sum("right").alias("r"), F.sum("given").alias("g"), F.min(value).alias("low"), F.max(value).alias("high"))
    wrong = per_key.where((F.col("r") != 1) | (F.col("g") != 1) | ~F.col("low").eqNullSafe(F.col("high"))).groupBy(*group).agg(F.count("*").alias("wrong_keys"))
    held = counts_before(rows.where("file_role in ('input', 'output')"), [*group, "file_role"]).groupBy(*group).agg(
        *[F.sum(F.when(F.col("file_role") == role, F.col(c))).alias(f"{c}_{name}") for role, name in (("input", "in"), ("output", "out")) for c in ("files", "rows")]
    )
    logged = log.select("compaction_id", *[F.col(c).cast("bigint").alias(c) for c in ("files_before", "files_after", "rows_before", "rows_after")]).distinct()
    same = F.lit(True)
    for c, h in (("files_before", "files_in"), ("files_after", "files_out"), ("rows_before", "rows_in"), ("rows_after", "rows_out")):
        same = same & F.col(c).eqNullSafe(F.coalesce(h, F.lit(0)))
    right_rows = F.col("rows_after").eqNullSafe(F.coalesce("made", F.lit(0)))
    return logged.join(held, group, "left").join(again, group, "left").join(wrong, group, "left").where(F.col("wrong_keys").isNotNull() | ~same | ~right_rows).select("compaction_id").distinct()


def _footers(listing: DataFrame) -> DataFrame:
    """path, length, folder, rows and schema (a hash of schema and column orders) of each file, from its footer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = FooterReader()
        for pdf in batches:
            rows, schemas = [], []
            for p in pdf["path"]:
                with _File(p) as f:
                    footer, signature = reader.read(footer_bytes(f)[0])
                rows.append(footer[3][1])
                schemas.append(hashlib.sha256(signature).hexdigest())
            yield pdf.assign(rows=rows, schema=schemas)

    narrow = listing.select("path", "length", "folder").repartition(python_tasks(listing.sparkSession))
    return stash(narrow.mapInPandas(run, "path string, length bigint, folder string, rows bigint, schema string"), "footers")


def compact_files(spark: SparkSession, source: str, target: str, target_bytes: int = TARGET_BYTES, dedup_keys: Sequence[str] | None = None, latest: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """Merge the Parquet files below ``source``, folder by folder, into files of about target_bytes below ``target``.

    Files whose schemas differ go to different files of the folder. With
    dedup_keys, files that hold a record of which another file holds a copy are
    rewritten without it first (only those are decoded), the others copied as they
    are; the copy with the greatest ``latest`` tuple stays (nulls lowest), without
    latest the first by path. Work goes to a staging folder; after totals are validated the new files
    are renamed into place. Returns one CompactionResult row per folder; ``target``
    must not exist. Files without rows vanish; other files in ``source`` are left
    alone, also Parquet files whose names aren't those of ``only`` (path), if given.
    """
    files = HadoopFiles(spark, target)
    if files.exists(target):
        raise FileExistsError(target)
    target = target.rstrip("/")
    staging = f"{target}/_staging-{uuid.uuid4().hex[:12]}"
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
        .select("path", "length", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    )
    listing = _footers(found if only is None else found.join(only.select(F.substring_index("path", "/", -1).alias("_name")), F.substring_index("path", "/", -1) == F.col("_name"), "left_semi"))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    work = _without_copies(spark, listing, f"{staging}/rewritten", list(dedup_keys), list(latest)) if dedup_keys else listing.select("*", F.lit(0).cast("bigint").alias("surplus"))
    full = work.where("rows > 0")
    sizes = full.groupBy("folder", "schema").agg(F.sum("length").alias("_total"))
    plan = (
        full.join(sizes, ["folder", "schema"])
        .withColumn("bin", F.pmod(F.xxhash64("path"), F.ceil(F.col("_total") / target_bytes)))
        .groupBy("folder", "schema", "bin")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))  # one bin: about target_bytes of files
    )

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = FooterReader()
        for pdf in batches:
            for folder, paths in zip(pdf["folder"], pdf["paths"]):
                with _new_file(staging) as (name, stream):
                    copier = BlockCopier(stream, reader)
                    for p in paths:
                        with _File(p) as f:
                            copier.add_file(f)
                    made = copier.finish()
                _check_written(name, made)
                yield pd.DataFrame({"folder": [folder], "staged": [name], "blocks": [made.blocks], "rows": [made.rows], "bytes": [made.size]})

    made = stash(plan.repartition(python_tasks(spark), "folder", "schema", "bin").mapInPandas(merge, "folder string, staged string, blocks bigint, rows bigint, bytes bigint"), "compaction")
    before = listing.groupBy("folder").agg(F.count("*").alias("files_before"), F.sum("length").alias("bytes_before"), F.sum("rows").alias("rows_before"))
    gone = work.groupBy("folder").agg(F.sum("surplus").alias("duplicate_rows_removed"))
    after = made.groupBy("folder").agg(F.count("*").alias("files_after"), F.sum("rows").alias("rows_after"), F.sum("blocks").alias("blocks"), F.sum("bytes").alias("bytes_after"))
    result = stash(before.join(gone, "folder", "left").join(after, "folder", "left").na.fill(0), "compaction-result")
    if result.where("rows_before - duplicate_rows_removed <> rows_after").limit(1).count():
        raise BlockMismatch("rows before and after differ; nothing was published")

    def place(row) -> None:
        inner = row.folder[len(base) :].lstrip("/")
        into = f"{target}/{inner}".rstrip("/")
        files.mkdirs(into)
        files.rename(row.staged, f"{into}/{row.staged.rsplit('/', 1)[1]}")

    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(place, made.select("folder", "staged").toLocalIterator()):  # one call per output file
            pass
    files.delete(staging)
    return result


def _kept_rows(spark: SparkSession, listing: DataFrame, columns: list[str]) -> DataFrame:
    """_path, _row and the given columns of every row of the files; only these columns are decoded."""
    sample = listing.where("rows > 0").groupBy("schema").agg(F.min("path").alias("path")).limit(1).collect()
    held = spark.read.parquet(sample[0].path).select(*columns).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.fields)
    types = {f.name: to_arrow_type(f.dataType, timestamp_utc=True) for f in held.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = arrow_fs(path)
                with fs.open_input_file(at) as f:
                    first = 0
                    for part in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(batch_size=50_000, columns=columns, use_threads=False):
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), *[part.column(c).cast(types[c]) for c in columns]], names=["_path", "_row", *columns])
                        first += n

    return listing.where("rows > 0").select("path").repartition(python_tasks(spark)).mapInArrow(run, f"_path string, _row bigint, {kinds}")


def _without_copies(spark: SparkSession, listing: DataFrame, parts: str, keys: list[str], latest: list[str]) -> DataFrame:
    """The listing with ``surplus``, where files that hold surplus copies are replaced by rewritten ones.

    Each file is rewritten with its own schema, so none loses a column that others
    lack; a file without a key column is an error.
    """
    if not listing.where("rows > 0").limit(1).count():
        return listing.select("*", F.lit(0).cast("bigint").alias("surplus"))
    rows = _kept_rows(spark, listing, list(dict.fromkeys([*keys, *latest]))).withColumn("_folder", F.regexp_extract("_path", r"^(.*)/[^/]+$", 1))
    rows = stash(rows.select("_folder", *keys, F.struct(*latest, "_path", "_row").alias("_place"), "_path", "_row"), "keys")
    first = rows.groupBy("_folder", *keys).agg((F.max if latest else F.min)("_place").alias("_keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    on = F.col("a._folder") == F.col("b._folder")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    surplus = rows.alias("a").join(first.alias("b"), on).where("a._path <> b._keep._path or a._row <> b._keep._row").select(F.col("a._path").alias("path"), F.col("a._row").alias("_row"))
    dirty = stash(surplus.groupBy("path").agg(F.collect_list("_row").alias("drop")).join(listing, "path"), "surplus")  # per file: rows of that file

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, folder, schema, drop in zip(pdf["path"], pdf["folder"], pdf["schema"], pdf["drop"]):
                fs, at = arrow_fs(path)
                with fs.open_input_file(at) as f:
                    held = pq.ParquetFile(f, coerce_int96_timestamp_unit="us")
                    old_times = any(held.schema.column(i).physical_type == "INT96" for i in range(len(held.schema)))  # kept as they are, so that schemas stay equal
                    whole = held.read(use_threads=False)
                keep = np.ones(whole.num_rows, dtype=bool)
                keep[np.asarray(drop, dtype=np.int64)] = False
                left = whole.filter(pa.array(keep))
                with _new_file(parts) as (name, stream):
                    pq.write_table(left, stream, compression="zstd", use_deprecated_int96_timestamps=old_times, store_schema=False)
                with _File(name) as f:
                    footer, signature = FooterReader().read(footer_bytes(f)[0])
                    size = f.size()
                yield pd.DataFrame({"path": [name], "length": [size], "folder": [folder], "rows": [footer[3][1]], "schema": [hashlib.sha256(signature).hexdigest()], "surplus": [len(drop)]})

    again = dirty.repartition(python_tasks(spark)).mapInPandas(rewrite, "path string, length bigint, folder string, rows bigint, schema string, surplus bigint")
    clean = listing.join(dirty.select("path"), "path", "left_anti").select("path", "length", "folder", "rows", "schema", F.lit(0).cast("bigint").alias("surplus"))
    return stash(clean.unionByName(again), "file-list")


def write_small_files(fragments: DataFrame, root: str) -> DataFrame:
    """Write the waiting fragments as the small Parquet files they came from: ``root``/<dataset>/<partition_path>/<file_name>.parquet.

    One row per file (dataset, partition_path, path). Null names become ``__null__``.
    """
    spark = fragments.sparkSession
    rows = clean_fragments(fragments).where("compaction_id is null and file_role = 'input'")
    named = rows.select(*[F.coalesce(c, F.lit("__null__")).alias(c) for c in ("dataset", "partition_path", "file_name")], *RECORD)
    work = named.repartition(python_tasks(spark), "dataset", "partition_path", "file_name").sortWithinPartitions("dataset", "partition_path", "file_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending = None, []

        def finish() -> pa.RecordBatch:
            path = f"{root}/{current[0]}/{current[1]}/{current[2].removesuffix('.parquet')}.parquet"
            fs, at = arrow_fs(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                pq.write_table(pa.Table.from_batches(pending), f, compression="zstd", use_dictionary=False, store_schema=False)
            return pa.RecordBatch.from_pydict({"dataset": [current[0]], "partition_path": [current[1]], "path": [path]})

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("dataset", "partition_path", "file_name")]
            keys = list(zip(*names))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != current:
                    if current is not None:
                        yield finish()
                    current, pending = keys[a], []
                pending.append(batch.select(RECORD).slice(a, b - a))
        if current is not None:
            yield finish()

    return stash(work.mapInArrow(run, "dataset string, partition_path string, path string"), "small-files")


def compact_small_files(fragments: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes the waiting fragments as real small files and compacts those with ``compact_files``; per dataset and partition its result."""
    spark = fragments.sparkSession
    root = scratch(spark, "small-files")
    HadoopFiles(spark, root).mkdirs(root)
    write_small_files(fragments, root)
    result = compact_files(spark, root, scratch(spark, "compacted-files"), target_bytes, KEY, ["ingested_at", "source_record_id"])
    inner = F.regexp_extract("folder", r"/small-files-[0-9a-f]{12}/(.*)$", 1)
    return result.select(
        F.substring_index(inner, "/", 1).alias("dataset"), F.expr(f"substring(regexp_extract(folder, '/small-files-[0-9a-f]{{12}}/[^/]*/(.*)$', 1), 1)").alias("partition_path"),
        "files_before", "files_after", "rows_before", "rows_after", "duplicate_rows_removed", "blocks", "bytes_before", "bytes_after",
    )
