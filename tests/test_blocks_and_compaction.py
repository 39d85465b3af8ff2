import datetime as dt
import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.operators import compaction
from tidegrid.operators.parquet_blocks import BlockCopier, BlockMismatch, SchemaMismatch, block_rows, merge_blocks, read_footer

D, T = dt.date, dt.datetime
FRAGMENT = "compaction_id string, file_role string, file_name string, file_bytes bigint, dataset string, partition_path string, symbol string, date date, close double, volume bigint, source string, source_record_id string, ingested_at timestamp"
LOG = "compaction_id string, files_before bigint, files_after bigint, rows_before bigint, rows_after bigint"


def encoded(table, **options):
    sink = io.BytesIO()
    pq.write_table(table, sink, **options)
    return sink.getvalue()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=5)), st.one_of(st.none(), st.integers(-5, 5)), st.lists(st.booleans(), max_size=3)), max_size=12), min_size=1, max_size=6), st.sampled_from(["snappy", "zstd", "none"]), st.integers(1, 7))
def test_round_trip_of_any_rows(files, codec, group):
    schema = pa.schema([("a", pa.string()), ("b", pa.int64()), ("c", pa.list_(pa.bool_()))])
    tables = [pa.table([[r[0] for r in f], [r[1] for r in f], [r[2] for r in f]], schema=schema) for f in files]
    out = merge_blocks(encoded(t, compression=codec, row_group_size=group, write_page_index=True) for t in tables)
    assert pq.read_table(io.BytesIO(out.data)).equals(pa.concat_tables(tables))
    assert out.rows == sum(t.num_rows for t in tables) and sum(block_rows(out.data)) == out.rows
    again = merge_blocks([out.data, out.data])
    assert again.rows == 2 * out.rows and again.blocks == 2 * out.blocks


def test_blocks_are_copied_as_bytes():
    one = encoded(pa.table({"a": list(range(1000))}), compression="zstd")
    group = read_footer(one)[4][1][1][0]
    meta = group[1][1][1][0][3][1]
    start = min(x for x in (meta[9][1], meta.get(11, [0, 0])[1]) if x > 0)
    assert one[start : start + meta[7][1]] in merge_blocks([one, one]).data


def test_schemas_must_be_equal():
    copier = BlockCopier()
    copier.add(encoded(pa.table({"a": [1]})))
    with pytest.raises(SchemaMismatch):
        copier.add(encoded(pa.table({"a": ["x"]})))
    with pytest.raises(ValueError):
        copier.add(b"no parquet at all")


def test_broken_totals_are_seen():
    data = bytearray(encoded(pa.table({"a": [1, 2, 3]})))
    with pytest.raises((BlockMismatch, ValueError, IndexError, KeyError)):
        merge_blocks([bytes(data[:4] + data[40:])])


def test_compact_files_keeps_every_record_once(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("p"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 1.5).alias("v"))
    df.repartition(20).write.partitionBy("p").parquet(str(src))
    result = compaction.compact_files(spark, str(src), str(tmp_path / "out"), target_bytes=20_000)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "v", F.col("p").cast("string"))) == rows(df.select("id", "v", "p"))
    for r in result.collect():
        assert r.rows_before == r.rows_after and r.files_after < r.files_before
    with pytest.raises(FileExistsError):
        compaction.compact_files(spark, str(src), str(tmp_path / "out"))


def test_compact_files_drops_copies_and_separates_schemas(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(6):
        pq.write_table(pa.table({"k": [i, i + 1, 100], "v": [1.0, 2.0, None]}), src / f"a{i}.parquet")
    pq.write_table(pa.table({"k": [500], "v": ["text"]}), src / "b.parquet")
    out = tmp_path / "out"
    first = compaction.compact_files(spark, str(src), str(out))
    assert first.first().files_after == 2 and first.first().rows_after == 19
    (src / "b.parquet").unlink()
    compaction.compact_files(spark, str(src), str(tmp_path / "once"), dedup_keys=["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [0, 1, 2, 3, 4, 5, 6, 100]


def test_files_with_copies_keep_their_own_columns(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    pq.write_table(pa.table({"k": [1, 3], "v": [1.0, 3.0]}), src / "a.parquet")
    pq.write_table(pa.table({"k": [1, 2], "v": [1.0, 2.0], "w": ["x", "y"]}), src / "b.parquet")
    pq.write_table(pa.table({"k": [3, 4], "v": [3.0, 4.0]}), src / "c.parquet")
    r = compaction.compact_files(spark, str(src), str(out), dedup_keys=["k"]).first()
    assert (r.rows_before, r.rows_after) == (4 + 2, 4)
    assert rows(spark.read.option("mergeSchema", "true").parquet(str(out)).select("k", "v", "w")) == [(1, 1.0, None), (2, 2.0, "y"), (3, 3.0, None), (4, 4.0, None)]
    assert all(p.parent == out for p in out.rglob("*.parquet"))


def fragment(cid, role, name, symbol="A", day=D(2024, 1, 1), close=1.0, volume=10, source="x", rid="r", at=T(2024, 1, 2), part="p=1"):
    return (cid, role, name, 100, "prices", part, symbol, day, close, volume, source, rid, at)


def test_wrong_compactions(spark):
    two = D(2024, 1, 2)
    data = [
        fragment("ok", "input", "i1"), fragment("ok", "input", "i2", " a "), fragment("ok", "input", "i2", "A", two), fragment("ok", "output", "o1", "a"), fragment("ok", "output", "o1", "A", two),
        fragment("lost", "input", "j1"), fragment("lost", "input", "j1", "B"), fragment("lost", "output", "q1"),
        fragment("twice", "input", "k1"), fragment("twice", "output", "r1"), fragment("twice", "output", "r1"),
        fragment("value", "input", "l1", close=None), fragment("value", "output", "s1", close=1.0),
        fragment("null", "input", "m1", close=None, symbol=None), fragment("null", "output", "t1", close=None, symbol=None),
        fragment("more", "input", "n1"), fragment("more", "output", "u1"), fragment("more", "output", "u1", "C"),
        fragment("count", "input", "v1"), fragment("count", "output", "w1"),
    ]
    log = [("ok", 2, 1, 3, 2), ("lost", 1, 1, 2, 1), ("twice", 1, 1, 1, 2), ("value", 1, 1, 1, 1), ("null", 1, 1, 1, 1), ("more", 1, 1, 1, 2), ("count", 1, 1, 1, 2), ("gone", 1, 1, 1, 1), ("nothing", 0, 0, 0, 0), ("ok", 2, 1, 3, 2)]
    f = spark.createDataFrame(data, FRAGMENT).withColumn("bin", F.lit("clash")).withColumn("files", F.lit(0))
    got = {r[0] for r in rows(compaction.wrong_compactions(f, spark.createDataFrame(log, LOG)))}
    assert got == {"lost", "twice", "value", "more", "count", "gone"}


def test_waiting_fragments_and_splitting_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(compaction, "BIN_ROWS", 50)
    monkeypatch.setattr(compaction, "BLOCK_ROWS", 20)
    data = [fragment(None, "input", f"f{i % 5}", f"S{i}", close=float(i)) for i in range(200)]
    data += [fragment(None, "input", "copy", "S3", close=-1.0, at=T(2024, 1, 1)), fragment(None, "input", "alone", "S1", part="p=2")]
    got = {r.partition_path: r for r in compaction.compact_waiting(spark.createDataFrame(data, FRAGMENT)).collect()}
    big = got["p=1"]
    assert (big.files_before, big.rows_before, big.rows_after, big.duplicate_rows_removed, big.validated) == (6, 201, 200, 1, True)
    assert 2 <= big.files_after <= 5 and got["p=2"].files_after == 1


def test_waiting_fragments_become_files(spark, monkeypatch):
    monkeypatch.setattr(compaction, "BIN_ROWS", 50)
    data = [fragment(None, "input", f"f{i % 5}", f"S{i}", close=float(i)) for i in range(120)]
    data += [fragment(None, "input", "copy", "s3", close=-1.0, at=T(2024, 1, 1)), fragment(None, "input", "null", None, close=None), fragment(None, "input", "alone", "S1", part="p=2")]
    result = compaction.compact_waiting(spark.createDataFrame(data, FRAGMENT))
    once = [(r[6], r[7], r[10], r[8], r[9], r[11], r[12]) for r in data if r[2] != "copy"]
    seen = set()
    for r in [*result.collect(), *result.collect()]:
        part = r.partition_path
        tables = [pq.read_table(p.removeprefix("file:")) for p in r.paths]
        assert len(tables) == r.files_after and sum(len(open(p.removeprefix("file:"), "rb").read()) for p in r.paths) == r.bytes_after
        wanted = [x for x, given in zip(once, (d for d in data if d[2] != "copy")) if given[5] == part]
        assert rows(spark.read.parquet(*r.paths).select("symbol", "date", "source", "close", "volume", "source_record_id", "ingested_at")) == sorted(wanted, key=lambda t: tuple((v is not None, str(v)) for v in t))
        assert sum(t.num_rows for t in tables) == r.rows_after
        seen |= {(part, p) for p in r.paths}
    assert {part for part, _ in seen} == {"p=1", "p=2"} and len(seen) == sum(r.files_after for r in result.collect())
    with pytest.raises(FileExistsError):
        compaction.compact_waiting(spark.createDataFrame(data, FRAGMENT), next(iter(seen))[1].rsplit("/", 1)[0])


def test_waiting_fragments_with_null_keys_stay(spark):
    data = [fragment(None, "input", "f1", part=None), fragment(None, "input", "f2", "B", part=None), fragment(None, "input", "f3"), (*fragment(None, "input", "f4")[:4], None, *fragment(None, "input", "f4")[5:])]
    got = {(r.dataset, r.partition_path): r for r in compaction.compact_waiting(spark.createDataFrame(data, FRAGMENT)).collect()}
    assert {k: (r.files_before, r.rows_before, r.rows_after) for k, r in got.items()} == {("prices", None): (2, 2, 2), ("prices", "p=1"): (1, 1, 1), (None, "p=1"): (1, 1, 1)}


def test_empty_tables(spark):
    f, log = spark.createDataFrame([], FRAGMENT), spark.createDataFrame([], LOG)
    assert rows(compaction.wrong_compactions(f, log)) == []
    assert rows(compaction.compact_waiting(f)) == []
    nulls = spark.createDataFrame([(None,) * 13] * 2, FRAGMENT)
    assert rows(compaction.compact_waiting(nulls)) == []
