from __future__ import annotations

import pytest

import nearfield as nf
from nearfield.jobs import aknn as aknn_job
from nearfield.jobs import build_tree
from nearfield.plans.staging import staging_folder
from tests.points import frame, rows


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_read_points(spark, tmp_path):
    path = write(tmp_path / "p.tsv", ["1\t0.5\t0.25", " 2\t0.75\t 0.125 ", "", "3\t1e-3\t0"])
    points = nf.read_points(spark, path)
    assert rows(points) == {(1, 0.5, 0.25), (2, 0.75, 0.125), (3, 0.001, 0.0)}
    path = write(tmp_path / "p3.tsv", ["1,0.5,0.25,0.75"])
    assert rows(nf.read_points(spark, path, 3, sep=",")) == {(1, 0.5, 0.25, 0.75)}


def test_malformed_lines(spark, tmp_path):
    bad = ["1\t0.5", "a\t0.1\t0.2", "3\t0.1\t0.2\t0.3\t0.4", ""]
    path = write(tmp_path / "p.tsv", [*bad, "4\t0.5\t0.5"])
    with pytest.raises(Exception, match="(?i)malformed"):
        nf.read_points(spark, path).collect()
    checked = nf.validate_points(nf.read_points(spark, path, on_error="keep").cache())
    assert rows(checked.good) == {(4, 0.5, 0.5)}
    assert [r.reason for r in checked.bad.collect()] == ["malformed line"] * 3


def test_validate_points(spark):
    points = spark.createDataFrame(
        [(1, 0.0, 0.5), (2, 1.0, 0.5), (3, -0.1, 0.5), (4, None, 0.5), (5, float("nan"), 0.5)]
        + [(6, 0.1, 0.1), (6, 0.2, 0.2)],
        "id bigint, x double, y double",
    )
    checked = nf.validate_points(points)
    assert sorted(r.id for r in checked.good.collect()) == [1, 6, 6]
    assert {r.id: r.reason for r in checked.bad.collect()} == {
        2: "outside domain",
        3: "outside domain",
        4: "missing value",
        5: "not finite",
    }
    assert rows(checked.duplicate_ids) == {(6, 2)}


def test_normalize_points(spark):
    points = frame(spark, [1, 2, 3], [[-5.0, 0.0], [5.0, 5.0], [0.0, 10.0]])
    scaled = nf.normalize_points(points)
    assert not nf.validate_points(scaled).bad.collect()
    x = {r.id: (r.x, r.y) for r in scaled.collect()}
    assert x[1] == (0.0, 0.0) and x[3][0] == pytest.approx(0.5)


def test_infer_dims(spark):
    assert nf.infer_dims(frame(spark, [1], [[0.1, 0.1]])) == 2
    assert nf.infer_dims(frame(spark, [1], [[0.1, 0.1, 0.1]])) == 3
    mixed = spark.createDataFrame(
        [(1, 0.1, 0.1, None), (2, 0.1, 0.1, 0.1)], "id bigint, x double, y double, z double"
    )
    with pytest.raises(ValueError, match="mixed"):
        nf.infer_dims(mixed)


def test_sample_points(spark):
    points = frame(spark, range(2000), [[i / 2000, 0.5] for i in range(2000)])
    some = nf.sample_points(points, 10, seed=3)
    assert 120 < some.count() < 280 and rows(some) <= rows(points)
    assert nf.sample_points(points, 100).count() == 2000
    for percent in (0, 101):
        with pytest.raises(ValueError, match="percent"):
            nf.sample_points(points, percent)


def test_neighbour_output(spark, tmp_path):
    lists = spark.createDataFrame(
        [(10, 2, 2, 0.02), (10, 1, 1, 0.0)], "qid bigint, rank int, tid bigint, dist double"
    )
    line = "10\t1\t0.0000000000\t2\t0.0200000000\t"
    assert nf.format_wide(lists).first().line == line
    nf.write_neighbors(lists, str(tmp_path / "wide"), "wide")
    assert spark.read.text(str(tmp_path / "wide")).first().value == line
    nf.write_neighbors(lists, str(tmp_path / "long"))
    assert rows(spark.read.parquet(str(tmp_path / "long"))) == rows(lists)
    with pytest.raises(ValueError, match="form"):
        nf.write_neighbors(lists, str(tmp_path / "x"), "csv")


def test_preview_and_report(spark):
    lists = spark.createDataFrame(
        [(2, 1, 7, 0.1), (1, 2, 8, 0.3), (1, 1, 9, 0.2)],
        "qid bigint, rank int, tid bigint, dist double",
    )
    assert [r.tid for r in nf.preview(lists, 2).collect()] == [9, 8]
    report = nf.run_report(spark, {"k": 2}, {"read": (3, 0.5), "join": (6, 1.5)}).collect()
    assert [(r.step, r.phase, r.n_rows) for r in report] == [(1, "read", 3), (2, "join", 6)]
    assert report[0].parameters == {"k": "2"}


def test_jobs(spark, tmp_path):
    data = [f"{i}\t{(i * 37 % 100) / 100}\t{(i * 59 % 100) / 100}" for i in range(300)]
    points = write(tmp_path / "t.tsv", data)
    tree, out, report = (str(tmp_path / name) for name in ("tree", "out", "report"))
    build_tree.main(
        ["--training", points, "--tree", tree, "--samplerate", "50", "--capacity", "20"]
    )
    assert nf.read_leaves(spark, tree).count() > 4
    arguments = ["--query", points, "--training", points, "--k", "3", "--report", report]
    for i, extra in enumerate((["--n", "10"], ["--partitioning", "qt", "--tree", tree])):
        aknn_job.main([*arguments, "--output", f"{out}{i}", "--method", "ps", *extra])
    lists = [rows(spark.read.parquet(f"{out}{i}")) for i in range(2)]
    assert len(lists[0]) == 900 and lists[0] == lists[1]
    assert spark.read.parquet(report).filter("phase = 'join'").first().n_rows == 900
    with pytest.raises(SystemExit):
        build_tree.main(["--training", points, "--tree", tree, "--type", "4"])


def test_staging_folder_is_the_sessions(spark):
    assert staging_folder(spark) == spark.conf.get("spark.checkpoint.dir")
