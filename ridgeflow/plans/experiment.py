"""Declared experiments: frozen references, content-addressed inputs, and the verdict on an effect."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ridgeflow.operators import experiments
from ridgeflow.plans.backtest import Effect
from ridgeflow.session import cut_lineage
from ridgeflow.sources.table_sets import digest_of


class ExperimentRefused(ValueError):
    """An experiment that is refused before anything of it is computed or written."""


@dataclass(frozen=True)
class ExperimentSpec:
    """What is declared of an experiment before it runs.

    ``effect`` plugs its pace, a column of profile rows, into the projection; ``target`` is the
    metric that it is to improve, under one ``clock``; ``weights`` weigh the classes of segments
    (one where a class is not named) and ``exclusions`` keep outings out, each with a reason."""

    effect: Effect
    target: str = "level"
    clock: int = 0
    weights: Mapping[str, float] = field(default_factory=dict)
    exclusions: Mapping[str, str] = field(default_factory=dict)

    def weight(self, klass: Column) -> Column:
        out = F.lit(1.0)
        for name, value in sorted(self.weights.items()):
            out = F.when(klass == name, float(value)).otherwise(out)
        return out


def frozen_references(references: DataFrame, clock: int) -> tuple[DataFrame, DataFrame]:
    """References under the declared clock, and who lends the borrowed ones.

    ``references``: ``route_id``, ``clock``, ``metric``, ``value``, ``motif``, ``days``. A local one per
    route and metric, with its motif where it has no value; for every metric with a value
    anywhere, one borrowed by the routes that lack their own: the plain mean of the locals.
    Returns (``metric``, ``source``, ``route_id``, ``value``, ``motif``, ``days``) and the donors
    (``metric``, ``route_id``)."""
    local = references.filter(F.col("clock") == clock).select(
        "metric", F.lit("local").alias("source"), "route_id", "value", "motif", F.col("days").cast("long").alias("days")
    )
    given = local.filter(F.col("value").isNotNull())
    none = F.lit(None).cast("string")
    borrowed = given.groupBy("metric").agg(F.avg("value").alias("value"), F.sum("days").cast("long").alias("days"))
    borrowed = borrowed.select(
        "metric",
        F.lit("borrowed").alias("source"),
        F.lit(None).cast(dict(local.dtypes)["route_id"]).alias("route_id"),
        "value",
        none.alias("motif"),
        "days",
    )
    return local.unionByName(borrowed), given.select("metric", "route_id")


def keep_table(df: DataFrame, root: str) -> str:
    """Writes a table under the digest of its content and returns the digest.

    A table that is there already is not written again: its address is what it holds."""
    rows = cut_lineage(df)
    digest = digest_of(rows).first()["digest"]
    try:
        known = digest_of(rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{digest}")).first()["digest"]
    except AnalysisException:
        known = None
    if known != digest:
        rows.write.mode("overwrite").parquet(f"{root}/{digest}")
    return digest


def kept_table(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """The table of a digest; refused if what stands there is no longer that table."""
    try:
        df = spark.read.parquet(f"{root}/{digest}")
    except AnalysisException as error:
        raise ExperimentRefused(f"no table of digest {digest}") from error
    if digest_of(df).first()["digest"] != digest:
        raise ExperimentRefused(f"the table of digest {digest} was changed")
    return df


def declare(spec: ExperimentSpec, inputs: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Checks and freezes an experiment: one row that says all that it depends on.

    ``inputs``: ``rows`` (``outing_id``, ``route_id``, ``k``, ``klass``, ``t_s``, ``length_m``,
    ``base_pace`` and what the effect reads), ``references`` (frozen). Refused, with nothing
    declared: exclusions of unknown outings, weights of unknown classes, a target without any
    reference row. Inputs are kept under their digests, and the row names these."""
    rows, references = inputs["rows"], inputs["references"]
    spark = rows.sparkSession
    found = rows.filter(F.col("outing_id").cast("string").isin(*spec.exclusions)) if spec.exclusions else rows.limit(0)
    known = {r[0] for r in found.select(F.col("outing_id").cast("string")).distinct().collect()}
    if unknown := sorted(set(spec.exclusions) - known):
        raise ExperimentRefused(f"exclusions of outings that are not there: {unknown}")
    classes = {r[0] for r in rows.filter(F.col("klass").isin(*spec.weights)).select("klass").distinct().collect()} if spec.weights else set()
    if unknown := sorted(set(spec.weights) - classes):
        raise ExperimentRefused(f"weights of classes that are not there: {unknown}")
    if references.filter(F.col("metric") == spec.target).isEmpty():
        raise ExperimentRefused(f"no reference of the target {spec.target}")
    digests = {name: keep_table(df, root) for name, df in inputs.items()}
    row = (
        "declaration", spec.effect.name, spec.target, spec.clock, json.dumps(dict(sorted(spec.weights.items()))),
        json.dumps(dict(sorted(spec.exclusions.items()))), json.dumps(dict(sorted(digests.items()))),
    )
    return spark.createDataFrame([row], "kind string, effect string, target string, clock int, weights string, exclusions string, digests string")


def assessed(spec: ExperimentSpec, rows: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assessments, guards) of an effect over its base, one pass over the profile rows.

    The target is the log ratio of weighted projected and observed times of an outing; guards
    are the same of each class alone. A class or outing without a positive observed time, or
    with a model output that is not a positive number, has the motif of that."""
    kept = rows.filter(~F.coalesce(F.col("outing_id").cast("string").isin(*spec.exclusions), F.lit(False))) if spec.exclusions else rows
    segments = kept.groupBy("outing_id", "route_id", "klass", "k").agg(
        F.sum(F.col("length_m") * F.col("base_pace")).alias("base"),
        F.sum(F.col("length_m") * spec.effect.pace).alias("candidate"),
        F.max("t_s").alias("t"),
    )
    weight = spec.weight(F.col("klass"))
    by_class = segments.groupBy("outing_id", "route_id", "klass").agg(
        *(F.sum(c).alias(c) for c in ("base", "candidate", "t")),
        F.max(F.coalesce(~((F.col("base") > 0) & (F.col("candidate") > 0)) | F.isnan("candidate") | (F.col("candidate") == float("inf")), F.lit(True))).alias("bad"),
    )

    def ratio(p: Column, t: Column) -> Column:
        return F.when((p > 0) & (t > 0), F.abs(F.log(p / F.nullif(t, F.lit(0.0)))))

    outings = by_class.groupBy("outing_id", "route_id").agg(
        *(F.sum(weight * F.col(c)).alias(c) for c in ("base", "candidate", "t")), F.max("bad").alias("bad")
    )
    local = references.filter(F.col("source") == "local").select("metric", "route_id", F.col("value").alias("_own"))
    lent = references.filter(F.col("source") == "borrowed").select("metric", F.col("value").alias("_lent"))
    found = outings.withColumn("metric", F.lit(spec.target)).join(local, ["metric", "route_id"], "left").join(lent, "metric", "left")
    motif = F.when(F.col("bad"), "model_error").when(~(F.col("t") > 0), "zero_time")
    gain = ratio(F.col("base"), F.col("t")) - ratio(F.col("candidate"), F.col("t"))
    assessments = found.select(
        F.lit(spec.effect.name).alias("effect"),
        "outing_id",
        "route_id",
        F.when(motif.isNull(), gain).alias("gain"),
        experiments.gain_threshold(F.coalesce("_own", "_lent")).alias("threshold"),
        motif.alias("motif"),
    )
    named = by_class.withColumn("metric", F.concat(F.lit("class_"), "klass"))
    guarded = named.join(local, ["metric", "route_id"], "left").join(lent, "metric", "left")
    harm = ratio(F.col("candidate"), F.col("t")) - ratio(F.col("base"), F.col("t"))
    limit = F.greatest(F.lit(experiments.HARM_FLOOR), experiments.HARM_SHARE * F.coalesce("_own", "_lent", F.lit(0.0)))
    guards = guarded.select(
        F.lit(spec.effect.name).alias("effect"), "outing_id", "metric", F.when(~F.col("bad"), harm).alias("harm"), limit.alias("threshold")
    )
    return assessments, guards


def run_experiment(spec: ExperimentSpec, declaration: DataFrame, root: str) -> DataFrame:
    """Verdict of a declared experiment, from the inputs as they were declared.

    Refused where the specification is not the declared one, or where an input no longer has
    its digest. One row: what was declared and what ``experiments.admit`` finds."""
    spark = declaration.sparkSession
    said = declaration.first()
    own = (spec.effect.name, spec.target, spec.clock, dict(spec.weights), dict(spec.exclusions))
    if own != (said["effect"], said["target"], said["clock"], json.loads(said["weights"]), json.loads(said["exclusions"])):
        raise ExperimentRefused("the specification is not the declared one")
    tables = {name: kept_table(spark, root, digest) for name, digest in json.loads(said["digests"]).items()}
    assessments, guards = assessed(spec, tables["rows"], tables["references"])
    verdict = experiments.admit(cut_lineage(assessments), guards, ["effect"])
    declared = declaration.select("effect", "target", "clock", "weights", "exclusions")
    return declared.join(verdict, "effect")
