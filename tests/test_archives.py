"""Archives: pushed filters, splits, skip tables and streams; shards put together from streams; sound at other rates."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import audio
from viewloom.sources import tar
from viewloom.streaming import assembly


def archive(path, members):
    with tarfile.open(path, "w") as t:
        t.addfile(_folder("d"))
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))


def _folder(name):
    info = tarfile.TarInfo(name)
    info.type = tarfile.DIRTYPE
    return info


@pytest.fixture
def shards(spark, tmp_path):
    """Four shards of samples, each a video and a description."""
    tar.register(spark)
    want = []
    for s in range(4):
        members = [(f"d/s{s}_{i}.{ext}", f"{s}-{i}-{ext}".encode() * (1 + 700 * (ext == "mp4"))) for i in range(20) for ext in ("mp4", "json")]
        archive(tmp_path / f"shard-{s:06}.tar", members)
        want += [(f"shard-{s:06}", n, len(c), c) for n, c in members]
    return f"{tmp_path}/shard-{{000000..000003}}.tar", want


def plain(df):
    return sorted((r["shard_name"], r["name"], r["size"], None if r["content"] is None else bytes(r["content"])) for r in df.collect())


@pytest.mark.parametrize("split", [1 << 30, 4096, 512])
def test_split_archives_give_each_member_once(spark, shards, split):
    paths, want = shards
    df = spark.read.format("tarshard").options(paths=f"{paths};/nowhere/x.tar", split_bytes=split).load()
    assert plain(df) == sorted(want)
    assert (df.rdd.getNumPartitions() > 4) == (split < 1 << 30)
    names = spark.read.format("tarshard").options(paths=paths, split_bytes=split, content="false").load()
    assert plain(names) == sorted((s, n, k, None) for s, n, k, _ in want)


def test_filters_reach_the_source(spark, shards, monkeypatch):
    paths, want = shards
    df = spark.read.format("tarshard").option("paths", paths).load()
    cases = [
        (F.col("shard_name") == "shard-000001", lambda r: r[0] == "shard-000001"), (F.col("name").endswith(".json") & (F.col("size") > 8), lambda r: r[1].endswith(".json") and r[2] > 8),
        (F.col("shard_name").isin("shard-000000", "shard-000003") & ~F.col("name").isin("d/s0_0.mp4"), lambda r: r[0][-1] in "03" and r[1] != "d/s0_0.mp4"),
        (F.col("name").startswith("d/s2_1") & (F.length("content") > 100), lambda r: r[1].startswith("d/s2_1") and r[2] > 100), (F.col("name").contains("_7."), lambda r: "_7." in r[1]),
    ]
    for condition, keep in cases:
        assert plain(df.where(condition)) == sorted(r for r in want if keep(r))
    from pyspark.sql.datasource import EqualTo, In, IsNull, Not

    reader = tar.TarReader({"paths": paths})
    rest = list(reader.pushFilters([EqualTo(("shard_name",), "shard-000002"), Not(In(("name",), ("d/s2_0.mp4",))), IsNull(("name",)), EqualTo(("content",), b"x")]))
    assert [type(f) for f in rest] == [IsNull, EqualTo] and [p.shard for p in reader.partitions()] == ["shard-000002"]
    read = []
    monkeypatch.setattr(tarfile.TarFile, "extractfile", lambda self, m: read.append(m.name) or io.BytesIO(b""))
    reader.tests.append(tar.Test.of(EqualTo(("name",), "d/s2_3.json")))
    assert [r[1] for r in reader.read(reader.partitions()[0])] == read == ["d/s2_3.json"]


def test_skip_tables(spark, shards, tmp_path):
    paths, want = shards
    gone = [(f"shard-{s:06}", f"s{s}_{i}") for s in range(3) for i in range(0, 20, 2)] + [("shard-000003", "s0_1"), ("other", "s3_1")]
    spark.createDataFrame(gone, "shard_name string, stem string").write.parquet(str(tmp_path / "skip"))
    df = spark.read.format("tarshard").options(paths=paths, skip_table=str(tmp_path / "skip"), skip="d/s1_1.mp4").load()
    left = lambda s, n: (s, n.split("/")[1].split(".")[0]) not in gone and n != "d/s1_1.mp4"
    assert plain(df) == sorted(r for r in want if left(r[0], r[1]))


def test_a_restarted_stream_reads_no_member_twice(spark, tmp_path):
    tar.register(spark)
    (tmp_path / "in").mkdir()

    def run(shards):
        for s in shards:
            archive(tmp_path / f"in/shard-{s:06}.tar", [(f"s{s}_{i}.mp4", b"x" * i) for i in range(5)])
        rows = spark.readStream.format("tarshard").options(folder=str(tmp_path / "in")).load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run([0, 1]) == sorted(f"s{s}_{i}.mp4" for s in (0, 1) for i in range(5))
    assert run([]) == sorted(f"s{s}_{i}.mp4" for s in (0, 1) for i in range(5))
    assert run([2, 3, 4]) == sorted(f"s{s}_{i}.mp4" for s in range(5) for i in range(5))


def test_shards_leave_when_whole(spark, tmp_path):
    sizes = {"a": 6, "b": 4, "c": 5, "d": 1}
    given = [("a", 0), ("b", 0), ("a", 1), ("a", 1), ("c", 0), ("b", 1), ("a", 2), ("d", 0), ("b", 2), ("a", 3), ("b", 3), ("b", 3), ("c", 1), ("a", 4), ("a", 5), ("d", 0), ("c", 2), ("a", 0)]
    schema = "shard_name string, shard_size int, id string, payload string"
    rows = [(s, sizes[s], f"{s}{i}", f"p{s}{i}") for s, i in given]

    def run(part):
        for k, r in part:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
        out = assembly.whole_shards(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("shard_name string, id string, payload string, n int, shard_size int").parquet(str(tmp_path / "out")).collect())

    first, second = list(enumerate(rows))[:9], list(enumerate(rows))[9:]
    assert {r[0] for r in run(first)} == {"d"}
    got = run(second)
    distinct = spark.createDataFrame(rows, schema).distinct()
    counts = {r["shard_name"]: r["count"] for r in distinct.groupBy("shard_name").count().collect()}
    whole = {s for s, n in counts.items() if n >= sizes[s]}
    assert {r[0] for r in got} == whole == {"a", "b", "d"}
    assert got == sorted((s, i, p, n, n) for s, n, i, p in (tuple(r) for r in distinct.collect()) if s in whole)


def test_shards_leave_after_a_silence_with_most_of_their_records(spark, tmp_path):
    import time

    schema = "shard_name string, shard_size int, id string, payload string"
    rows = [("most", 100, f"m{i}", "x") for i in range(99)] + [("some", 100, f"s{i}", "x") for i in range(50)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = assembly.whole_shards(stream, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        read = lambda: spark.read.schema("shard_name string, n int").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
        for _ in range(40):
            time.sleep(1)
            if read():
                break
        time.sleep(3)
        assert {(r["shard_name"], r["n"]) for r in read()} == {("most", 99)} and len(read()) == 99
    finally:
        q.stop()


def test_resampling_keeps_low_tones_and_drops_high_ones():
    rate, to = 44_100, 16_000
    t = np.arange(rate) / rate
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 9_500 * t)
    got = audio.resampled(low + high, rate, to)
    want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / to)
    assert len(got) == to and np.abs(got[500:-500] - want[500:-500]).max() < 1e-3
    up = audio.resampled(low, rate, 48_000)
    assert len(up) == 48_000 and np.abs(up[500:-500] - np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)[500:-500]).max() < 1e-3
    assert audio.resampled(low, rate, rate) is low and len(audio.resampled(np.zeros(0), rate, to)) == 0


def test_masks_are_zero():
    f = np.ones((30, 20))
    for axis in (0, 1):
        widths = set()
        for seed in range(60):
            out = audio.masked(f, seed, 6, axis)
            gone = (out == 0).all(axis=1 - axis)
            assert (out[~gone] if axis == 0 else out[:, ~gone]).all() and gone.sum() <= 6
            at = np.flatnonzero(gone)
            assert len(at) == 0 or at[-1] - at[0] + 1 == len(at)
            widths.add(int(gone.sum()))
        assert {0, 6} <= widths and f.all()
