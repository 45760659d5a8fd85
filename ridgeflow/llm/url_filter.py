"""URL filters: rules on host and path, and gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeflow.session import cut_lineage

#: Labelled URLs that the trees are fitted on, about, and the seed that picks them.
FIT_ROWS = 20_000
SEED = 7
TREES, DEPTH, STEP = 20, 4, 0.3
#: Rules of the registered query: (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Weight, in labelled URLs, of the share of all when a suffix has few of its own.
SUFFIX_PRIOR = 20.0
#: Rates of a fitted URL come from the labels outside its fold, of so many.
FOLDS = 5
#: Values of one kind, and their bytes, that may be broadcast with their rates.
BROADCAST_VALUES, BROADCAST_BYTES = 200_000, 16 << 20


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or if null."""
    text = F.coalesce(F.col(url), F.lit(""))
    cut = F.instr(text, "://")
    rest = F.when(cut > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule that fits and its verdict; the longest wins, null if none fits.

    A rule fits its host and all subdomains of it, if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones override
        at = text.index("/") if "/" in text else len(text)
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character of a short text."""
    letters = F.split(text, "")
    size = F.char_length(text).cast("double")
    plain = F.array_distinct(letters)
    # n of each distinct character, by what its removal leaves.
    counts = F.transform(plain, lambda c: size - F.char_length(F.replace(text, c, F.lit(""))))
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + F.when(n > 0, n * F.log2(n)).otherwise(0.0))
    return F.when(size > 0, F.log2(size) - total / size).otherwise(0.0)


def lexical_features(df: DataFrame, url: str, host: Column, path: Column) -> DataFrame:
    """Adds lexical features: lengths, depth, shares, entropy, parameters and suffixes.

    All are finite for empty and null URLs (zeros)."""
    text = F.coalesce(F.col(url), F.lit(""))
    length = F.char_length(text).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    share = lambda n: F.when(length > 0, n / length).otherwise(0.0)
    return df.withColumns(
        {
            "f_length": length,
            "f_host_length": F.char_length(host).cast("double"),
            "f_path_length": F.char_length(path).cast("double"),
            "f_depth": _count(path, "/[^/]"),
            "f_labels": _count(host, r"[^.]+"),
            "f_digits": share(_count(text, "[0-9]")),
            "f_upper": share(_count(text, "[A-Z]")),
            "f_marks": share(_count(text, r"[-_%~=&+]")),
            "f_host_digits": _count(host, "[0-9]"),
            "f_host_marks": _count(host, "-"),
            "f_parameters": _count(query, r"[^&;]+"),
            "f_query_length": F.char_length(query).cast("double"),
            "f_fragment": text.contains("#").cast("double"),
            "f_secure": text.startswith("https").cast("double"),
            "f_path_slash": path.endswith("/").cast("double"),
            "f_entropy": _entropy(text),
            "f_host_entropy": _entropy(host),
            # Suffixes: last label of the host, ending of the path, first piece of the path.
            "suffix": F.regexp_extract(host, r"([^.:]*)(?::[0-9]*)?$", 1),
            "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
            "first": F.regexp_extract(path, r"^/([^/]*)", 1),
        }
    )


_PARTS = ("suffix", "ending", "first")


def _features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("f_")] + [f"{p}_rate" for p in _PARTS]


@dataclass(frozen=True)
class UrlModel:
    """Fitted trees, the labels counted by suffix value and the share of blocked URLs."""

    trees: GBTClassificationModel | None
    counts: DataFrame | None
    share: float

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score``, the chance that the URL is one to block."""
        if self.trees is None:
            return df.withColumn("score", F.lit(self.share))
        df = with_rates(df, self.counts, self.share)
        ready = VectorAssembler(inputCols=_features(df), outputCol="features").transform(df)
        scored = self.trees.transform(ready)
        return scored.withColumn("score", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction"
        )


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Labels of every suffix value: ``part``, ``value``, ``n`` and ``bad``, arrays by fold.

    All labelled rows count and every value stays; the table is written."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("value")) for p in _PARTS)))
    rows = labelled.select("label", _fold("url").alias("fold"), each.alias("of")).select("label", "fold", "of.*")
    sums = [(F.count(F.when(F.col("fold") == k, 1)), F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0.0))) for k in range(FOLDS)]
    return cut_lineage(
        rows.groupBy("part", "value").agg(
            F.array(*(n.cast("double") for n, _ in sums)).alias("n"), F.array(*(bad for _, bad in sums)).alias("bad")
        )
    )


def with_rates(df: DataFrame, counts: DataFrame, share: float, fitted: bool = False) -> DataFrame:
    """Adds the block rate of each suffix, shrunk to the share; an unmet value has the share.

    For ``fitted`` rows the labels of their own fold do not count: a rare value would give
    away their own label. Tables are broadcast only behind a check of their size."""
    bounds = counts.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).collect()
    few = {r["part"] for r in bounds if r["n"] <= BROADCAST_VALUES and (r["bytes"] or 0) <= BROADCAST_BYTES}
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    for part in _PARTS:
        own = counts.where(F.col("part") == part).select(F.col("value").alias("_value"), F.col("n").alias("_n"), F.col("bad").alias("_bad"))
        df = df.join(F.broadcast(own) if part in few else own, F.col(part) == F.col("_value"), "left")
        n, bad = total("_n"), total("_bad")
        if fitted:
            n, bad = n - F.get("_n", _fold("url")), bad - F.get("_bad", _fold("url"))
        rate = (bad + SUFFIX_PRIOR * share) / (n + SUFFIX_PRIOR)
        df = df.withColumn(f"{part}_rate", F.coalesce(rate, F.lit(share))).drop("_value", "_n", "_bad")
    return df


def fit_url_model(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> UrlModel:
    """Boosted trees from labelled URLs (``label`` 1 to block, 0 to allow, lexical features).

    The trees are fitted on about ``fit_rows`` rows, picked by a hash of the URL. Suffix
    statistics are those of all labelled rows and every value: block rates, shrunk to the
    share of all. With labels of one kind only, or none, every URL gets their share (0.5 if
    none)."""
    stats = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    share = 0.5 if stats["share"] is None else float(stats["share"])
    if share in (0.0, 1.0) or not stats["n"]:
        return UrlModel(None, None, share)
    counts = suffix_counts(labelled)
    part = min(1.0, fit_rows / stats["n"])
    picked = labelled.where(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    ready = with_rates(picked, counts, share, fitted=True)
    ready = VectorAssembler(inputCols=_features(ready), outputCol="features").transform(ready)
    learner = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=SEED)
    return UrlModel(learner.fit(ready.select("features", "label").coalesce(8)), counts, share)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Host, path, fitting rule, verdict and score of every URL.

    URLs that a rule decides are the labelled ones that the trees learn from; the trees then
    judge the rest (block from a score of one half on). Null and empty URLs have an empty
    host and path, fit no rule and are judged by the trees like any other. Repeated rows are
    judged alike; other columns are ignored."""
    host, path = url_parts("url")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    featured = lexical_features(base.withColumns({"rule": rule, "said": said}), "url", F.col("host"), F.col("path"))
    labelled = featured.where("rule IS NOT NULL").withColumn("label", (F.col("said") == "block").cast("double"))
    scored = fit_url_model(labelled).score(featured)
    judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "score")
