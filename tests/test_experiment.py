"""Declared experiments: frozen references, kept inputs, and what is refused."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ridgeflow.plans import experiment
from ridgeflow.plans.backtest import Effect


@pytest.fixture
def spec(spark):
    return experiment.ExperimentSpec(Effect("slower", F.col("base_pace") * 1.1), weights={"ascent": 2.0}, exclusions={"o3": "rain"})


def _inputs(spark):
    rows = [
        (o, "r1" if o < "o3" else "r2", k, "ascent" if k else "flat", 100.0 * (0 if (o, k) == ("o4", 1) else 1), 100.0, 0.9)
        for o in ("o1", "o2", "o3", "o4")
        for k in range(2)
    ]
    rows = spark.createDataFrame(rows, "outing_id string, route_id string, k int, klass string, t_s double, length_m double, base_pace double")
    references = [("r1", 0, "level", 0.08, None, 3), ("r2", 0, "level", None, "insufficient", 1), ("r1", 2, "level", 9.0, None, 3)]
    references = spark.createDataFrame(references, "route_id string, clock int, metric string, value double, motif string, days int")
    return {"rows": rows, "references": experiment.frozen_references(references, 0)[0]}


def test_frozen_references_lend_their_mean(spark):
    frozen = {(r["source"], r["route_id"]): r for r in _inputs(spark)["references"].collect()}
    assert set(frozen) == {("local", "r1"), ("local", "r2"), ("borrowed", None)}
    assert frozen["borrowed", None]["value"] == 0.08 and frozen["borrowed", None]["days"] == 3
    assert frozen["local", "r2"]["motif"] == "insufficient"


def test_refusals(spark, spec, tmp_path):
    inputs, root = _inputs(spark), str(tmp_path / "kept")
    for bad, said in (
        (replace(spec, exclusions={"o9": "rain"}), "o9"),
        (replace(spec, weights={"descent": 1.0}), "descent"),
        (replace(spec, target="dispersion"), "dispersion"),
    ):
        with pytest.raises(experiment.ExperimentRefused, match=said):
            experiment.declare(bad, inputs, root)
    assert not (tmp_path / "kept").exists()
    declared = experiment.declare(spec, inputs, root)
    with pytest.raises(experiment.ExperimentRefused, match="declared"):
        experiment.run_experiment(replace(spec, weights={"ascent": 3.0}), declared, root)
    # An input that changes after the declaration is refused; one that is written again is not.
    digest = experiment.keep_table(inputs["rows"].repartition(5), root)
    assert experiment.run_experiment(spec, declared, root).count() == 1
    inputs["rows"].limit(3).write.mode("overwrite").parquet(f"{root}/{digest}")
    with pytest.raises(experiment.ExperimentRefused, match="changed"):
        experiment.run_experiment(spec, declared, root)


def test_verdict_and_motifs(spark, spec, tmp_path):
    inputs, root = _inputs(spark), str(tmp_path / "kept")
    assessments, guards = experiment.assessed(spec, inputs["rows"], inputs["references"])
    rows = {r["outing_id"]: r for r in assessments.collect()}
    assert set(rows) == {"o1", "o2", "o4"}  # o3 is excluded
    assert rows["o1"]["threshold"] == pytest.approx(0.02) and rows["o4"]["threshold"] == pytest.approx(0.02)
    assert rows["o1"]["gain"] == pytest.approx(0.1053605 - 0.0100503, abs=1e-6)
    held = {(r["outing_id"], r["metric"]): r["harm"] for r in guards.collect()}
    assert held["o4", "class_ascent"] is None and held["o4", "class_flat"] < 0
    out = experiment.run_experiment(spec, experiment.declare(spec, inputs, root), root).first()
    assert (out["effect"], out["target"], out["evaluable"], out["verdict"]) == ("slower", "level", 3, "to_review")
