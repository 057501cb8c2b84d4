"""Readers of data sets, chunk results, stored models, options and SQL functions."""

import numpy as np
import pytest

from viewloom.functions import config, sql
from viewloom.operators import clustering
from viewloom.sources import files, sinks


def test_split_lists(spark, tmp_path):
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits/classInd.txt").write_text("1 Run\n2 Swim\n")
    (tmp_path / "splits/trainlist01.txt").write_text("Swim/a.avi 2\n\nRun/b.avi 1\n")
    (tmp_path / "splits/testlist01.txt").write_text("Run/c.avi\n")
    (tmp_path / "splits/testlist02.txt").write_text("Fly/c.avi\n")
    got = files.split_lists(spark, str(tmp_path), "train", 1, 2).collect()
    assert {(r["path"].rpartition("/")[2], r["label"], r["clip"]) for r in got} == {("a.avi", 1, 0), ("a.avi", 1, 1), ("b.avi", 0, 0), ("b.avi", 0, 1)}
    assert [r["label"] for r in files.split_lists(spark, str(tmp_path), "val", 1).collect()] == [0]
    with pytest.raises(Exception, match="no such class"):
        files.split_lists(spark, str(tmp_path), "test", 2).collect()


def test_fold_files(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    for n in ("1-100-A-7.wav", "2-100-B-3.wav", "2-101-A-7.wav"):
        (tmp_path / "audio" / n).write_bytes(b"x")
    name = lambda mode: sorted((r["path"].rpartition("/")[2], r["label"]) for r in files.fold_files(spark, str(tmp_path), mode, 2).collect())
    assert name("train") == [("1-100-A-7.wav", 7)] and name("test") == [("2-100-B-3.wav", 3), ("2-101-A-7.wav", 7)]


def test_labelled_folders(spark, tmp_path):
    for n in ("train/zebra/a.mp4", "train/ape/b.mp4", "train/ape/c.mp4", "train/ape/c.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = files.labelled_folders(spark, str(tmp_path), "train", 2).collect()
    assert sorted((r["path"].rpartition("/")[2], r["label"], r["clip"]) for r in got) == [(f, k, c) for f, k in (("a.mp4", 1), ("b.mp4", 0), ("c.mp4", 0)) for c in (0, 1)]


def test_lists_of_addresses_and_models(spark, tmp_path):
    (tmp_path / "u.txt").write_text("http://a/x\n\n  http://b/y \n")
    assert [r["line"] for r in files.lines(spark, str(tmp_path / "u.txt")).collect()] == ["http://a/x", "http://b/y"]
    (tmp_path / "zoo.md").write_text("# Zoo\n| name | link |\n| --- | --- |\n| small | [`link`](http://a/s.pkl) |\n| large | [x](http://a/l.pkl) |\n")
    assert [tuple(r) for r in files.model_list(spark, str(tmp_path / "zoo.md")).collect()] == [("small", "http://a/s.pkl"), ("large", "http://a/l.pkl")]


def test_chunks_are_written_again_and_reduced(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert sinks.unfinished_chunks(spark, path, 3) == [0, 1, 2]
    sinks.write_chunk(spark.range(3), path, 0)
    sinks.write_chunk(spark.range(4), path, 2)
    sinks.write_chunk(spark.range(2), path, 0)
    assert sinks.unfinished_chunks(spark, path, 3) == [1]
    out = sinks.reduce_chunks(spark, path)
    assert out.columns == ["id"] and out.count() == 6


def test_models_are_found_by_their_shards(spark, tmp_path):
    path = str(tmp_path / "models")
    for epoch, shards in ((0, ["a"]), (1, ["a", "b"]), (2, ["a", "b", "c"])):
        sinks.write_model(spark, clustering.Model(np.full((2, 2), float(epoch)), np.arange(2.0)), path, epoch, shards)
    at = lambda shards, subset: (m := sinks.read_model(spark, path, shards, subset)) and m.centers[0, 0]
    assert at(["a", "b"], True) == 1 and at(["a", "b", "c", "d"], True) == 2 and at(["a", "c"], False) == 2 and at(["z"], True) is None
    assert sinks.read_model(spark, path, ["a"]).counts.tolist() == [0, 1]


def test_options():
    base = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert config.merged(base, {"a": {"c": {"d": 5}}, "f": 1}) == {"a": {"b": 1, "c": {"d": 5}}, "e": 3, "f": 1}
    assert config.overridden(base, {"a.c.d": 7, "x.y": 1, "e.z": 2}) == {"a": {"b": 1, "c": {"d": 7}}, "e": {"z": 2}, "x": {"y": 1}}
    assert base == {"a": {"b": 1, "c": {"d": 2}}, "e": 3} and config.unknown(base, {"a.b": 1, "a.x": 1, "q": 2}) == ["a.x", "q"]


def test_functions_in_sql_text(spark):
    sql.register(spark)
    assert tuple(spark.sql("select n_log_n(0), n_log_n(1), pairs_of(4), mi_term(2, 2, 2, 4)").first()) == pytest.approx((0, 0, 6, 0.5 * np.log(2)))


def test_archives_are_dealt_to_nodes_and_workers(spark, tmp_path):
    import tarfile

    from viewloom.sources import tar

    (tmp_path / "a.txt").write_text("x")
    for i in range(7):
        with tarfile.open(tmp_path / f"shard-{i}.tar", "w") as t:
            t.add(tmp_path / "a.txt", "a.txt")
    tar.register(spark)
    seen = []
    for node in range(2):
        for worker in range(2):
            rows = spark.read.format("tarshard").options(paths=f"{tmp_path}/shard-{{0..6}}.tar", nodes=2, node=node, workers=2, worker=worker).load()
            seen.append(sorted(r["shard_name"] for r in rows.collect()))
    assert seen == [["shard-0", "shard-4"], ["shard-2", "shard-6"], ["shard-1", "shard-5"], ["shard-3"]]


def test_shapes_of_lists_and_maps(spark):
    from viewloom.operators import records

    df = spark.createDataFrame([("k", [1, 2], ["a", "b"])], "k string, x array<int>, y array<string>")
    assert [tuple(r) for r in records.transposed(df, ["x", "y"]).collect()] == [("k", 0, 1, "a"), ("k", 1, 2, "b")]
    rows = spark.createDataFrame([("m", "p", 1), ("m", "q", 2), ("n", "p", 3)], "o string, i string, v int")
    assert {r["i"]: r["v"] for r in records.levels_exchanged(rows, "o", "i", "v").collect()} == {"p": {"m": 1, "n": 3}, "q": {"m": 2}}
    maps = spark.createDataFrame([({"x": 1}, {"x": 2})], "a map<string,int>, b map<string,int>")
    assert records.flat_maps(maps, ["a", "b"]).first()["flat"] == {"a_x": 1, "b_x": 2}
    files = spark.createDataFrame([("s", "f"), ("s", "g"), ("s", "g")], "shard_name string, filename string")
    assert [tuple(r) for r in records.non_matching(files, files.where("filename = 'f'")).collect()] == [("s", "g", 2)]
    gaps = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert [tuple(r) for r in records.complete_modalities(gaps, ["a", "b"]).collect()] == [(3, 4)]


def test_best_row_and_cut(spark):
    from viewloom.operators import ordering

    df = spark.createDataFrame([(3, 1.0), (2, 5.0), (1, 5.0), (0, None)], "id int, score double")
    assert tuple(ordering.best(df, "score").first()) == (1, 5.0) and ordering.best(df.limit(0), "score").count() == 0
    assert [r["id"] for r in ordering.cut(df, 2).collect()] == [0, 1]


def test_option_grids():
    from viewloom.operators import pairing

    options = pairing.grid({"weight_type": [None, "linear", "exp:1", "exp:900"], "k": [1]})
    assert [o["weight_type"] for o in pairing.without_overflow(options)] == [None, "linear", "exp:1"]
    assert pairing.run_grid(options, lambda o: o["k"] + 1, 2) == [2] * 4


def test_payloads_are_prepared_and_may_be_dropped(spark):
    from viewloom.operators import extract

    only = extract.Extractor("x", "audio", lambda ps: [{"layer_0": np.array([len(p)])} for p in ps], lambda p: p[1:] if len(p) > 1 else None)
    assert [g and int(g["layer_0"][0]) for g in only([b"abc", b"a", None])] == [2, None, None]
    assert extract.serving(["byte_histogram", "projection"], ["audio"]) == ["byte_histogram"]
