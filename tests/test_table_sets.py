"""Sets of tables that appear together, stored reports and the hash tree of a folder."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from ridgeflow.sources import table_sets, tables


def _frame(spark, n, athlete="a"):
    return spark.createDataFrame([(i, f"v{i}", athlete, [i], {"k": i}) for i in range(n)], "x int, v string, athlete_id string, l array<int>, m map<string, int>")


def test_a_writer_that_dies_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "sets")
    with pytest.raises(ValueError):
        table_sets.read_set(spark, root)
    first = table_sets.publish({"one": _frame(spark, 3), "two": _frame(spark, 4)}, root, "p1")
    broken = _frame(spark, 5).withColumn("x", F.expr("IF(x = 4, raise_error('killed'), x)").cast("int"))
    with pytest.raises(Exception, match="killed"):
        table_sets.publish({"one": _frame(spark, 9), "two": broken}, root, "p2")
    held = table_sets.read_set(spark, root)
    assert {n: t.count() for n, t in held.items()} == {"one": 3, "two": 4}
    assert table_sets.current(spark, root)["version"] == first
    second = table_sets.publish({"one": _frame(spark, 9), "two": _frame(spark, 8)}, root, "p3")
    assert {n: t.count() for n, t in table_sets.read_set(spark, root).items()} == {"one": 9, "two": 8}
    assert {n: t.count() for n, t in held.items()} == {"one": 3, "two": 4}  # a reader keeps its version
    assert table_sets.current(spark, root)["version"] == second
    with pytest.raises(ValueError, match="three"):
        table_sets.read_set(spark, root, ["one", "three"])


def test_lost_rows_are_seen(spark, tmp_path):
    root = str(tmp_path / "sets")
    version = tables.table_sets.publish({"one": _frame(spark, 30).repartition(3), "none": _frame(spark, 0)}, root, "p")
    assert [r["intact"] for r in table_sets.verify_set(spark, root).collect()] == [True, True]
    part = next((tmp_path / "sets" / "sets" / version / "one").rglob("part-*.parquet"))
    part.unlink()
    assert {r["name"]: r["intact"] for r in table_sets.verify_set(spark, root).collect()} == {"one": False, "none": True}
    digest = lambda df: table_sets.digest_of(df).first()["digest"]
    assert digest(_frame(spark, 9)) == digest(_frame(spark, 9).repartition(4)) != digest(_frame(spark, 9).union(_frame(spark, 1)))


def test_activities_and_points_together(spark, tmp_path):
    root = str(tmp_path / "a")
    tables.write_activities(_frame(spark, 2), _frame(spark, 7), root, "p")
    assert {n: t.count() for n, t in table_sets.read_set(spark, root).items()} == {"activities": 2, "points": 7}


def test_stored_reports(spark, tmp_path):
    root = tmp_path / "results"
    root.mkdir()
    assert table_sets.stored_reports(spark, str(root))[1].first().asDict() == {"readable": 0, "unreadable": 0}
    good = json.dumps({"generated_on": "2024-02-03", "tables": {"flow": "abc"}})
    texts = {
        "2024-02-03_q1": good,
        "2024-02-04_q1": good,  # another date than its name
        "2024-02-05_q1": "{not json",
        "2024-02-06_q1": json.dumps({"generated_on": "2024-02-06"}),
        "2024-02-07_q1": None,
        ".2024-02-08_q1": "{unfinished",
    }
    for name, text in texts.items():
        (root / name / "flow").mkdir(parents=True)
        (root / name / "flow" / "part.csv").write_text("a,b\n")
        if text is not None:
            (root / name / "provenance").mkdir()
            (root / name / "provenance" / "part.txt").write_text(text)
    (root / "note.txt").write_text("not a folder")
    results, counts = table_sets.stored_reports(spark, str(root))
    assert [(r["folder"], str(r["generated_on"]), r["tables"]) for r in results.collect()] == [("2024-02-03_q1", "2024-02-03", {"flow": "abc"})]
    assert counts.first().asDict() == {"readable": 1, "unreadable": 4}


def test_hash_tree(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for n in range(150):  # more than a leaf holds
        folder = one / f"f{n % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n}.json").write_text(f'{{"n": {n}}}')
    (one / "f0" / "other.txt").write_text("x")
    shutil.copytree(one, two)
    (two / "f1" / ".DS_Store").write_text("x")
    of = lambda root: tuple(tables.fingerprint(spark, str(root), "*.json").first())
    first = of(one)
    assert first[1] == 150 and first == of(two)
    (two / "f3" / "3.json").write_text('{"n": -3}')
    assert of(two)[0] != first[0]
    (two / "f3" / "3.json").rename(two / "f3" / "moved.json")
    (two / "f3" / "moved.json").write_text('{"n": 3}')
    assert of(two)[0] != first[0]
    (tmp_path / "empty").mkdir()
    assert of(tmp_path / "empty")[1] == 0 and len(of(tmp_path / "empty")[0]) == 64
