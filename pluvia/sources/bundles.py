"""Model bundles: JSON files of small trees by class, checked and turned into columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import trees
from pluvia.operators.nowcast import capped, on_knots
from pluvia.sources.matrix import opened

TREE = "struct<feature: array<int>, threshold: array<double>, left: array<int>, right: array<int>, default_left: array<boolean>, missing: array<int>, value: array<double>>"
SCHEMA = f"`set` string, fold int, features array<string>, classes array<struct<dbz: double, trees: array<{TREE}>, calib_x: array<double>, calib_y: array<double>, pstar: map<string, double>>>, trained string"


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row a file (.json or .json.gz) under a path: its name, and what SCHEMA names."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json(\.gz)?$", 1)
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("name", name)


def save(found: dict[tuple[str, int], str], path: str) -> None:
    """Bundles' texts by (set, fold) as files of a folder: set_fold0, set_fold1, and the set alone for fold -1. A file is
    written beside its place and then moved there, so readers see all of it or nothing."""
    store, root = opened(path)
    store.create_dir(root, recursive=True)
    for (set_, fold), text in found.items():
        name = f"{root}/{set_}.json" if fold < 0 else f"{root}/{set_}_fold{fold}.json"
        beside = f"{root}/.{set_}-{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as f:
            f.write(text.encode())
        store.move(beside, name)


def faults(found: DataFrame, known: list[str]) -> DataFrame:
    """(name, fault) of the bundles that break a rule: unknown features, no classes, arrays of unequal
    length, splits on features that are not there, children that do not come after their parent."""
    odd = F.size(F.array_except(F.coalesce("features", F.array().cast("array<string>")), F.array(*map(F.lit, known)))) > 0
    none = F.coalesce(F.size("classes"), F.lit(0)) < 1
    n = lambda t: F.size(t["feature"])
    uneven = lambda t: (n(t) < 1) | ~F.forall(F.array(*[F.size(t[c]) for c in ("threshold", "left", "right", "default_left", "missing", "value")]), lambda s: s == n(t))
    nodes = lambda t: F.arrays_zip(t["feature"], t["left"], t["right"])
    loose = lambda t, v, i: (v["feature"] >= 0) & ((v["left"] <= i) | (v["right"] <= i) | (v["left"] >= n(t)) | (v["right"] >= n(t)))
    bad = lambda t: uneven(t) | F.exists(F.transform(nodes(t), lambda v, i: (v["feature"] >= F.size("features")) | loose(t, v, i)), lambda b: b)
    broken = F.exists("classes", lambda c: F.exists(c["trees"], lambda t: F.coalesce(bad(t), F.lit(True))))
    fault = F.when(odd, "unknown feature").when(none, "no classes").when(broken, "malformed tree")
    return found.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def sets(found: DataFrame) -> DataFrame:
    """(set, whole) of the sets of which both folds are there; whole: whether one trained on all is too."""
    fold = F.regexp_extract("name", r"_fold([01])$", 1)
    by = found.select(F.regexp_replace("name", r"_fold[01]$", "").alias("set"), fold.alias("f"))
    return by.groupBy("set").agg(F.count_distinct(F.when(F.col("f") != "", F.col("f"))).alias("folds"), F.bool_or(F.col("f") == "").alias("whole")).where("folds = 2").select("set", "whole")


def uses(prefix: str) -> Column:
    """Whether a bundle reads any feature that starts so."""
    return F.exists("features", lambda f: f.startswith(prefix))


def _nodes(t: Row) -> list[trees.Node]:
    return [trees.Node(t["value"][i], f, t["threshold"][i], t["left"][i], t["right"][i], t["default_left"][i], t["missing"][i]) for i, f in enumerate(t["feature"])]


def probabilities(bundle: Row) -> list[Column]:
    """A column for each class of one bundle over a table that has its features: calibrated, and never
    rising with strength. A bundle is one bounded file."""
    out = []
    for c in bundle["classes"]:
        p = trees.probability([_nodes(t) for t in c["trees"]], [F.col(f) for f in bundle["features"]])
        out.append(on_knots(p, list(c["calib_x"] or []), list(c["calib_y"] or [])))
    return capped(out)
