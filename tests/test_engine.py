"""Invariants, identities and brute-force versions of operators that SQL does not express."""

import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import names, numbers
from viewloom.operators import agreement, clips, clustering, contrastive, metadata, ordering, pairing, records, retrieval, selection
from viewloom.sources import files, sinks, tar
from viewloom.streaming import ingest

RNG = np.random.default_rng(3)
ROWS = RNG.integers(0, 4, (60, 4))
PAIRS = pairing.combination(["a_0", "a_1", "b_0", "b_1"])


def brute_mi(rows, pairs):
    out = []
    for i, j in pairs:
        n, v = len(rows), 0.0
        for x in set(rows[:, i]):
            for y in set(rows[:, j]):
                c = ((rows[:, i] == x) & (rows[:, j] == y)).sum()
                if c:
                    v += c / n * math.log(c * n / (rows[:, i] == x).sum() / (rows[:, j] == y).sum())
        out.append(v)
    return out


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(ROWS)], "id long, a array<int>")
    return agreement.contingency(df, PAIRS)


def test_mi_forms_agree(cells):
    direct = [r["mi"] for r in agreement.mutual_information(cells).orderBy("pair").collect()]
    s = agreement.sums(cells)
    sums = [r["v"] for r in s.select("pair", agreement.mi_from_sums(*[F.col(c) for c in ("nn", "aa", "bb", "n")]).alias("v")).orderBy("pair").collect()]
    assert np.allclose(direct, brute_mi(ROWS, PAIRS)) and np.allclose(direct, sums)


def test_pair_counts_sum_to_all_pairs(cells):
    for r in agreement.pair_counts(cells).collect():
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 60 * 59 / 2


def test_every_measure_has_a_row_per_pair(cells):
    for f in agreement.MEASURES.values():
        assert f(cells).count() == len(PAIRS)


@pytest.mark.parametrize("name", sorted(selection.MEASURES))
def test_candidate_scores_equal_scores_of_enlarged_sets(name):
    state = selection.Counts(ROWS, PAIRS)
    state.add(np.arange(10))
    got = selection.MEASURES[name](state, np.arange(10, 30))
    if name == "mi":
        want = [np.mean(brute_mi(ROWS[[*range(10), c]], PAIRS)) for c in range(10, 30)]
        assert np.allclose(got, want)
    assert got.shape == (20,) and np.isfinite(got).all()


def test_batch_of_all_candidates_taking_one_is_greedy():
    a = selection.greedy(ROWS, PAIRS, 12, selection.information, [0])
    b = selection.batch(ROWS, PAIRS, 12, selection.information, [0], width=len(ROWS), take=1)
    assert [x for x, _ in a] == [x for x, _ in b]


@pytest.mark.parametrize("strategy", sorted(selection.STRATEGIES))
def test_selection_is_whole_and_distinct(spark, strategy):
    df = spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(ROWS)], "id long, chunk int, a array<int>")
    got = selection.select(df, PAIRS, 0.2, strategy=strategy).toPandas()
    assert len(got) == 12 and got["id"].is_unique and set(got.groupby("chunk").size()) == {6}


def test_selection_finds_planted_truth(spark):
    """Rows whose clusterings agree are preferred to shuffled ones."""
    k = RNG.integers(0, 5, 200)
    rows = np.stack([k, k, k, k], 1)
    rows[100:] = RNG.integers(0, 5, (100, 4))
    got = selection.batch(rows[(order := RNG.permutation(200))], PAIRS, 60, selection.information, [0])
    assert np.mean([order[r] < 100 for r, _ in got]) > 0.7


def test_start_rows_cover_clusters():
    got = selection.start_rows("cluster", ROWS)
    assert all(set(ROWS[got, c]) == set(ROWS[:, c]) for c in range(4))
    assert selection.start_rows("zero", ROWS[:0]) == []


def test_kmeans_step_takes_a_share_of_each_row():
    m = clustering.Model(np.ones((2, 2)), np.zeros(2))
    new = clustering.step(m, np.array([[4.0, 8.0], [0, 0]]), np.array([4.0, 0]), 0.01)
    assert np.allclose(new.centers, [[1.0, 1.04], [1, 1]]) and new.counts.tolist() == [4, 0]
    cut = clustering.step(m, np.array([[4.0, 8.0], [3, 3]]), np.array([4.0, 1]), 0.3)  # a rate of 0.5 / 4 instead
    assert np.allclose(cut.centers, [[1.0, 1.5], [1.25, 1.25]])


def test_kmeans_finds_separate_groups(spark):
    x = np.concatenate([RNG.normal(m, 0.1, (50, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    model = clustering.train(df, 6, epochs=12, batch=8, initial_rounds=1, rate=lambda e: 0.05)
    got = clustering.assign(df.withColumn("clustering", F.lit("c")), {"c": model}).agg(F.avg("distance")).first()[0]
    assert got < 5
    _, axes = clustering.principal(df, 1)
    assert abs(abs(axes[0] @ np.array([1, 1]) / math.sqrt(2)) - 1) < 1e-2


def test_contrastive_gradient():
    a, b = RNG.normal(size=(6, 3)), RNG.normal(size=(6, 4))
    p = contrastive.Projection.start(3, 4, 2)
    _, g = contrastive.loss_and_gradient(p, a, b)
    for part, grad in zip(p.parts(), g, strict=True):
        at = (0,) * part.ndim
        part[at] += 1e-5
        more, _ = contrastive.loss_and_gradient(p, a, b)
        part[at] -= 2e-5
        less, _ = contrastive.loss_and_gradient(p, a, b)
        part[at] += 1e-5
        assert abs((more - less) / 2e-5 - grad[at]) < 1e-4


def test_contrastive_training_lowers_the_loss(spark):
    z = RNG.normal(size=(256, 4))
    df = spark.createDataFrame([(i, v.tolist(), (v @ np.ones((4, 4)) + v).tolist()) for i, v in enumerate(z)], "id long, va array<double>, vb array<double>")
    _, losses = contrastive.train(df, m=4, epochs=4, rate=0.05)
    assert losses[-1] < losses[0]


def test_pairings_and_weights():
    n = ["a_x", "a_y", "b_x", "b_y"]
    assert pairing.diagonal(n) == [(0, 2), (1, 3)] and pairing.layer(1)(n) == [(1, 3)] and len(pairing.bipartite(n)) == 4
    assert pairing.weights([0, 1, 2], "onehot_1") == [0, 1, 0] and len(pairing.grid({"x": [1, 2], "y": [3, 4, 5]})) == 6


def test_derangement_moves_all_but_the_kept(spark):
    df = spark.range(20).withColumn("label", F.col("id") % 2)
    got = retrieval.derange_within(df, 0.5, 1, ["label"], buckets=3).toPandas()
    assert sorted(got["partner"]) == list(range(20)) and got["is_true"].sum() == 10
    assert (got["partner"] % 2 == got["label"]).all()


def test_diverse_clips(spark):
    df = spark.createDataFrame([("v", 1, 2, 0.1), ("v", 1, 3, 0.9), ("v", 2, 3, 0.5)], "video string, a int, b int, score double")
    assert [r["clip"] for r in clips.diverse(df, 2).orderBy("rank").collect()] == [1, 2]


def test_shots_and_fallback(spark):
    b = spark.createDataFrame([("v", 4.0), ("v", 30.0)], "video string, t double")
    got = clips.valid(clips.shots(b), 10, crop=True)
    assert [tuple(r) for r in got.select("start", "end").collect()] == [(12.0, 22.0)]
    vids = spark.createDataFrame([("v", 40.0), ("w", 6.0)], "video string, duration double")
    assert ("w", -2.0, 8.0) in [tuple(r) for r in clips.with_fallback(got, vids, 10).collect()]


def test_repeated_suffix_is_an_error(spark):
    m = spark.createDataFrame([("s", "x.mp4", "1"), ("s", "x.mp4", "2")], "shard_name string, name string, content string")
    with pytest.raises(Exception, match="repeated suffix"):
        records.samples_by_prefix(m).collect()


def test_names(spark):
    df = spark.createDataFrame([("d/abcdefghijk_012.tar.mp4",), ("noext",)], "p string")
    got = df.select(names.stem(F.col("p")), names.suffix(F.col("p")), names.clip_id(names.file_name(F.col("p"))), names.clip_start(F.lit("abcdefghijk_012.mp4")), names.layer_of(F.lit("a_b_c"))).collect()
    assert tuple(got[0]) == ("abcdefghijk_012.tar", ".mp4", "abcdefghijk", 12, "b_c") and got[1][1] == ""
    assert df.select(numbers.hhmmss(F.lit(3725.5))).first()[0] == "01:02:5.500000"


def test_metadata_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "How to Cook", None, "x"), (2, 50.0, "cook how", "a", "y"), (3, 50.0, "fine", "b", None)], "id int, length double, title string, description string, category string")
    r = metadata.Rules(10, 100, title_phrases=(("how", "cook"),), categories=("z",))
    assert [x["id"] for x in metadata.keep(df, r).collect()] == [3]
    ordered = metadata.Rules(10, 100, title_phrases=(("how", "cook"),), in_order=True)
    assert [x["id"] for x in metadata.keep(df, ordered).orderBy("id").collect()] == [2, 3]


def test_brace_patterns():
    assert files.expand("s-{000..002}.{a,b}") == ["s-000.a", "s-000.b", "s-001.a", "s-001.b", "s-002.a", "s-002.b"]


def test_metadata_and_keyword_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('http://x/watch?v=abcdefghijk\t{"LatestDAFeature": {"Title": "T", "VideoLength": "12", "PubDate": "60"}}\nbad line\n')
    row = files.metadata_columns(files.metadata(spark, str(tmp_path / "m.tsv"))).collect()
    assert len(row) == 1 and row[0]["length"] == 12.0 and row[0]["title"] == "T"
    (tmp_path / "k.csv").write_bytes(b"keywords,,\r\nlet,play,\r\ngame,,\r\ngame,,\r\n")
    assert sorted(tuple(r[0]) for r in files.keywords(spark, str(tmp_path / "k.csv")).collect()) == [("game",), ("let", "play")]


def test_shard_metadata_and_logs(spark, tmp_path):
    (tmp_path / "shard-000001.json").write_text('[{"filename": "a.mp4", "id": "a", "segment": [1, 2]}, {"filename": "b.mp4", "id": "b", "segment": [3, 4]}]')
    got = files.shard_metadata(spark, str(tmp_path / "shard-*.json")).collect()
    assert {(r["shard_name"], r["stem"], r["shard_size"]) for r in got} == {("shard-000001", "a", 2), ("shard-000001", "b", 2)}
    sinks.write_log(spark, str(tmp_path / "logs"), "h", 1, "2", "t", ["x", "y"])
    logs = files.run_logs(spark, str(tmp_path / "logs"))
    out = records.shard_partitions(spark.createDataFrame([("x",), ("z",)], "shard_name string"), logs)
    assert {tuple(r) for r in out.collect()} == {("x", 0), ("z", -1)}


def test_tar_source(spark, tmp_path):
    for s in ("0", "1"):
        with tarfile.open(tmp_path / f"shard-{s}.tar", "w") as t:
            for n in ("a.mp4", "a.json"):
                (tmp_path / n).write_text(n + s)
                t.add(tmp_path / n, n)
    tar.register(spark)
    rows = spark.read.format("tarshard").option("paths", f"{tmp_path}/shard-{{0..1}}.tar;{tmp_path}/none.tar").load()
    assert rows.count() == 4
    one = records.samples_by_prefix(rows).where("shard_name = 'shard-1'").first()
    assert bytes(one["sample"]["mp4"]) == b"a.mp41"


def test_selection_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", "f.mp4", "i", [69, 79], 0)], "shard_name string, filename string, id string, segment array<int>, pos int")
    sinks.write_selection(df, str(tmp_path / "out"), ["pos"])
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == b's,f.mp4,i,"[69, 79]"\r\n'
    assert sinks.read_selection(spark, str(tmp_path / "out")).first()["segment"] == "[69, 79]"


def test_shard_writer_replaces_only_its_shards(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "shard_name string, v int")
    sinks.write_shards(df, str(tmp_path / "o"))
    sinks.write_shards(spark.createDataFrame([("s2", 3)], "shard_name string, v int"), str(tmp_path / "o"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).select("shard_name", "v").collect()} == {("s1", 1), ("s2", 3)}


def test_stream_reads_files_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(3).write.parquet(src)
    for n in (3, 5):
        ingest.run_available(ingest.shards(spark, src, spark.range(1).schema), lambda r: r, out, cp).awaitTermination()
        assert spark.read.parquet(out).count() == n
        spark.range(2).write.mode("append").parquet(src)


def test_online_model(spark, tmp_path):
    spark.createDataFrame([([float(i), 0.0],) for i in range(4)], "vec array<double>").write.parquet(str(tmp_path / "s"))
    m = clustering.Model(np.array([[0.0, 0], [9, 9]]), np.ones(2))
    ingest.online_model(ingest.shards(spark, str(tmp_path / "s"), spark.read.parquet(str(tmp_path / "s")).schema), m, str(tmp_path / "m"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).where("batch = 0").count() == 2


def test_online_model_goes_on_after_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("s", "m", "c"))
    rows = lambda v: spark.createDataFrame([([float(v), 0.0],)] * 4, "vec array<double>")
    first = clustering.Model(np.array([[0.0, 0], [90, 90]]), np.zeros(2))
    rows(8).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest.online_model(ingest.shards(spark, src, schema), first, out, cp).awaitTermination()
    rows(16).write.mode("append").parquet(src)
    ingest.online_model(ingest.shards(spark, src, schema), first, out, cp).awaitTermination()
    got = ingest.last_model(spark, out)
    assert got.counts.tolist() == [8, 0] and np.allclose(got.centers[0], [0.96 * 0.04 * 8 + 0.04 * 16, 0])


def test_not_a_number_is_an_error(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="not a number in x"):
        records.no_nan(df, "x").collect()


def test_places_in_groups_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 5), ("b", 2)], "g string, v int")
    got = ordering.numbered_by(df, ["g"], ["v"], buckets=2).collect()
    assert sorted((r["g"] or "", r["v"], r["pos"], r["size"]) for r in got) == [("", 5, 0, 2), ("", 5, 1, 2), ("a", 1, 0, 2), ("a", 3, 1, 2), ("b", 2, 0, 1)]


def test_positions_are_gapless(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    got = ordering.numbered(df, ["x"], buckets=5).collect()
    assert all(r["x"] == r["pos"] for r in got)


def test_positions_are_gapless_beyond_the_sample_of_a_range_partition(spark):
    """With pruned and with extra columns; bounds drawn twice would differ on a table of this size."""
    n = 3_000_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("x"), F.md5(F.col("id").cast("string")).alias("part"), F.lit(1).alias("at"), F.lit(2).alias("row"))
    got = ordering.numbered(df, ["x"], buckets=8)
    assert got.columns == [*df.columns, "pos"]
    bad, least, most, distinct = got.agg(F.sum((F.col("x") != F.col("pos")).cast("int")), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert (bad, least, most, distinct) == (0, 0, n - 1, n)
    drawn = ordering.numbered(df.select("part", "x"), ["part", "x"], buckets=8).agg(F.max("pos"), F.count_distinct("pos")).first()
    assert tuple(drawn) == (n - 1, n)


def test_log_mel_shapes_and_peak():
    from viewloom.functions import audio

    t = np.arange(16000 * 2) / 16000
    x = np.sin(2 * np.pi * 1000 * t)
    e = audio.examples(np.stack([x, x], 1), 16000)
    assert e.shape == (2, 96, 64) and audio.examples(x[:100], 16000).shape == (0, 96, 64)
    centre = np.linspace(audio.mel(125), audio.mel(7500), 66)[1:-1]
    assert abs(e.mean((0, 1)).argmax() - np.abs(centre - audio.mel(1000)).argmin()) <= 1
    assert audio.padded(e[0]).shape == (128, 64) and audio.framed(x, 400, 160).shape[0] == 1 + (len(x) - 400) // 160
    assert (audio.masked(e[0], 1, 20, 0) != e[0]).any(1).sum() <= 20 and audio.hann(4).tolist() == pytest.approx([0, 0.5, 1, 0.5])
    with pytest.raises(ValueError, match="band edges"):
        audio.mel_matrix(8, 10, 100, 0, 80)


def test_mel_columns(spark):
    from viewloom.functions import audio

    df = spark.createDataFrame([(RNG.normal(size=16000).tolist(),), (None,)], "x array<double>")
    got = df.select(audio.clip_examples(F.col("x"), 16000).alias("e"), audio.evaluation_mel(F.col("x"), 16000).alias("m")).collect()
    assert len(got[0]["e"]) == 1 and len(got[0]["e"][0]) == 96 * 64 and len(got[0]["m"]) == 128 * 80 and got[1]["m"] is None


def test_crop_geometry(spark):
    from viewloom.functions import geometry as g

    df = spark.createDataFrame([(240, 320, 0), (240, 320, 2), (480, 200, 1)], "h int, w int, p int")
    got = df.select(g.scaled(F.col("h"), F.col("w"), F.lit(120)).alias("s"), g.uniform_crop(F.col("h"), F.col("w"), 200, F.col("p")).alias("c"), g.drawn_crop(F.col("h"), F.col("w"), 100, F.col("p"), 1).alias("d"), g.flipped(F.col("p"), 1).alias("f")).collect()
    assert tuple(got[0]["s"]) == (120, 160) and [tuple(r["c"]) for r in got] == [(20, 0), (20, 120), (140, 0)]
    assert all(0 <= r["d"]["y"] <= 380 for r in got)


def test_extraction_to_shards(spark):
    from viewloom.operators import extract

    df = spark.createDataFrame([("s", "a", bytearray(b"xyz")), ("s", "b", None)], "shard_name string, filename string, content binary")
    rows = extract.extract(df, ["byte_histogram", "projection"])
    assert {(r["filename"], r["layer"], len(r["vec"])) for r in rows.where("model = 'byte_histogram'").collect()} == {("a", "layer_0", 64), ("a", "layer_1", 16)}
    shard = extract.as_shards(rows).collect()
    assert len(shard) == 1 and {f["view"] for f in shard[0]["features"]} == {"audio", "video"}
