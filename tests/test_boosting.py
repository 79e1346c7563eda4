"""Continued boosting: patience, margins, members, successive halving."""

import json

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from stormcell.operators import local_trees as LT
from stormcell.operators import metrics as M
from stormcell.operators import models as MD

FEATS = ["a", "b", "c"]
SMALL = {"maxDepth": 2, "stepSize": 0.5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(scale=0.7, size=600) > 0.4).astype(int)
    data = [(i, *map(float, a), int(b), "validation" if i % 3 == 0 else "train", 1.0 + i % 2) for i, (a, b) in enumerate(zip(x, y))]
    return MD.cut_lineage(spark.createDataFrame(data, "id int, a double, b double, c double, y int, split string, w double"))


def held():
    return F.col("split") == "validation"


def test_patience_keeps_the_best_round(rows, monkeypatch):
    monkeypatch.setattr(MD, "CHUNK", 3)
    fit = MD.fit_patient(rows, FEATS, "y", held(), "w", patience=4, maxIter=40, **SMALL)
    assert fit.best == int(np.argmin(fit.losses[:fit.best + 4])) + 1 > 1
    assert fit.ended == fit.best + 4 < 40 and len(fit.losses) < fit.ended + 3
    assert fit.model.stages[-1].getNumTrees == fit.best
    scored = MD.score(rows.where(held()), fit.model, "p").toPandas()
    loss = -np.log(np.where(scored["y"] == 1, scored["p"], 1 - scored["p"])).mean()
    assert loss == pytest.approx(fit.losses[fit.best - 1], abs=1e-9)  # the kept trees are those of the best round


def test_going_on_is_the_longer_fit(rows):
    """Rounds added in two steps are those of one step; no tree is fitted twice."""
    one, two = (MD.start_boosting(rows, FEATS, "y", held(), **SMALL) for _ in range(2))
    MD.add_rounds(one, 6)
    MD.add_rounds(two, 2)
    first = list(two.trees)
    MD.add_rounds(two, 4)
    assert two.trees[:2] == first and two.losses == pytest.approx(one.losses)
    assert all(b < a for a, b in zip(one.losses, one.losses[1:3]))


def test_first_tree_is_a_newton_step(rows):
    """A stump's leaves: the mean of (y - 1/2) / (1/4) of their train rows, times the rate."""
    fit = MD.start_boosting(rows, FEATS, "y", held(), "w", **{**SMALL, "maxDepth": 1, "stepSize": 1.0})
    MD.add_rounds(fit, 1)
    d = fit.rows.where("not held").toPandas()
    for _, g in d.groupby("margin"):
        assert g["margin"].iloc[0] == pytest.approx(np.average(4 * (g["label"] - 0.5), weights=g["weight"]))


def test_members_and_their_blend(rows):
    members = MD.fit_members(rows, FEATS, "y", held(), {"m1": 30, "m2": 5}, "w", patience=3, maxIter=12, **SMALL)
    out = rows
    for name, m in members.items():
        out = MD.score(out, m.model, name)
    out = MD.cut_lineage(MD.blend(out, {"m1": 1.0, "m2": 3.0}, "p").where(held()))
    aucs = {c: M.auc(out, "y", c).first()["auc"] for c in ("m1", "m2", "p")}
    assert aucs["p"] >= min(aucs["m1"], aucs["m2"]) > 0.7


def test_rows_without_label_and_validation(rows):
    fit = MD.start_boosting(rows.withColumn("y", F.when(F.col("id") > 50, F.col("y"))), FEATS, "y", F.lit(False), **SMALL)
    assert fit.rows.count() == 549
    MD.add_rounds(fit, 1)
    assert fit.losses == [float("inf")] and MD.best_round(fit.losses, 2) == (1, False)


def test_search_settings_are_fixed_and_in_range():
    a, b = MD.search_settings(), MD.search_settings()
    assert a == b and len(a) == 20 and len({json.dumps(x) for x in a}) == 20
    assert all(0.03 <= x["stepSize"] <= 0.3 and x["maxDepth"] in range(3, 8) for x in a)


def test_successive_halving(rows, monkeypatch):
    monkeypatch.setattr(MD, "CHUNK", 4)
    settings = [{**SMALL, "stepSize": s, "maxDepth": d, "maxIter": 16} for s in (0.001, 0.3, 0.6) for d in (1, 2)]
    got = {r["trial"]: r for r in MD.search_params(rows, FEATS, "y", held(), settings, first_rounds=2, patience=4).collect()}
    assert sorted(got) == list(range(6))
    last = [r for r in got.values() if r["dropped_at"] is None]
    assert len(last) == 1 and [r["dropped_at"] for r in got.values()].count(1) == 3
    assert {r["rounds"] for r in got.values() if r["dropped_at"] == 1} == {2}
    assert {r["rounds"] for r in got.values() if r["dropped_at"] == 2} == {4}
    assert last[0]["rounds"] >= 8 and last[0]["best_round"] <= last[0]["rounds"]
    dropped = [r["val_auc"] for r in got.values() if r["dropped_at"] == 1]
    alone = MD.start_boosting(rows, FEATS, "y", held(), **settings[last[0]["trial"]])
    MD.add_rounds(alone, 2)
    assert MD._held_auc(alone) >= max(dropped)


def test_weight_search_counts_nulls_nowhere(spark):
    d = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.8, 0.1), (1, None, 0.9), (None, 0.9, 0.9), (1, 0.1, 0.1)], "y int, a double, b double")
    got = {r["trial"]: r for r in MD.search_weights(d, ["a", "b"], "y", [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]).collect()}
    assert [tuple(got[k][c] for c in ("tp", "fp", "fn")) for k in (0, 1, 2)] == [(1, 1, 1), (0, 0, 2), (0, 0, 0)]


def test_a_small_fit_is_one_job_for_all_rounds(rows):
    """More rounds are not more jobs: the rounds of a fit whose rows fit into a task run in that task."""
    sc, jobs = rows.sparkSession.sparkContext, []
    for k, rounds in enumerate((2, 9)):
        fit = MD.start_boosting(rows, FEATS, "y", held(), "w", **SMALL)
        sc.setJobGroup(f"rounds-{k}", "")
        MD.add_rounds(fit, rounds)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{k}")))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(fit.trees) == rounds == len(fit.losses)
    assert jobs[0] == jobs[1] <= 4


@pytest.mark.parametrize("params", [
    {"maxDepth": 5, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    {"maxDepth": 3, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}])
def test_rounds_in_a_task_are_those_by_jobs(rows, params):
    """Both ways draw the same rows and columns and find the same trees, to the last bit; columns that say the same included."""
    d = rows.withColumns({"c": F.when(F.col("c") > 0.5, 0.0).otherwise(F.round("c", 1)), "a2": 2 * F.col("a") + 1, "k": F.lit(7.0)})
    feats = [*FEATS, "a2", "k"]
    one, many = (MD.start_boosting(d, feats, "y", held(), "w", **{**params, "stepSize": 0.3}) for _ in range(2))
    assert one.one_task
    many.one_task = False
    for fit in (one, many):
        MD.add_rounds(fit, 3)
    assert one.losses == pytest.approx(many.losses, rel=1e-13)
    assert [list(r) for r in one.rows.collect()] == [list(r) for r in many.rows.collect()]
    a, b = (MD.boosted_model(fit) for fit in (one, many))
    assert a.stages[-1].toDebugString.split("\n")[1:] == b.stages[-1].toDebugString.split("\n")[1:]
    assert a.stages[-1].featureImportances == b.stages[-1].featureImportances


def test_joined_leaves_say_what_they_said(spark):
    """Leaves of one prediction under a node become one leaf with that prediction, not with the mean of its own sums."""
    r = np.random.default_rng(11)
    x, w = r.normal(size=(400, 3)).round(2), r.choice([0.1980574, 3.3], 400)
    y = np.where(x[:, 0] + x[:, 1] > 0.3, 2.0, -2.0)
    joined = 0
    for seed in range(3):
        d = spark.createDataFrame([tuple(map(float, v)) for v in np.c_[x, y, w]], "a double, b double, c double, y double, w double").coalesce(1)
        d = MD.cut_lineage(MD.assembler(FEATS).transform(d).select("features", "y", "w"))
        want = RandomForestRegressor(labelCol="y", weightCol="w", numTrees=1, bootstrap=False, maxDepth=6, subsamplingRate=1.0,
                                     featureSubsetStrategy="0.6", seed=seed).fit(d)
        got = LT.grow(LT.columns_of(x), y, w, seed, 6, 1, 1.0, "0.6")
        assert [t[0] for t in want.transform(d).select("prediction").collect()] == LT.predicted(got, x).tolist()
        joined += sum(n["leftChild"] < 0 and n["prediction"] != n["impurityStats"][1] / n["impurityStats"][0] for n in got)
    assert joined  # the case is there


def test_a_large_sample_gives_the_same_tree(spark):
    """Beyond 10,000 rows the split candidates come from a draw of the rows: the same one, by gaps or row by row."""
    r = np.random.default_rng(5)
    for n in (14_000, 30_000):
        x, w = r.normal(size=(n, 2)).round(3), r.uniform(0.1, 2.0, n)
        y = x[:, 0] - x[:, 1] ** 2 + r.normal(size=n)
        d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x[:, 0], x[:, 1], y, w))], "i int, a double, b double, y double, w double")
        d = MD.cut_lineage(MD.assembler(["a", "b"]).transform(d.coalesce(1).sortWithinPartitions("i")).select("features", "y", "w"))
        want = RandomForestRegressor(labelCol="y", weightCol="w", numTrees=1, bootstrap=False, maxDepth=4, subsamplingRate=0.8,
                                     featureSubsetStrategy="all", seed=7).fit(d)
        got = LT.grow(LT.columns_of(x), y, w, 7, 4, 1, 0.8, "all")
        assert [t[0] for t in want.transform(d).select("prediction").collect()] == LT.predicted(got, x).tolist()


def test_rows_of_many_tasks(rows, monkeypatch):
    """Rows that do not fit into one task go through Spark's own trees, with the same stop."""
    monkeypatch.setattr(MD, "ROWS_PER_TASK", 250)
    monkeypatch.setattr(MD, "CHUNK", 3)
    fit = MD.start_boosting(rows, FEATS, "y", held(), "w", **SMALL)
    assert not fit.one_task and fit.rows.rdd.getNumPartitions() == 3
    MD.add_rounds(fit, 40, 4)
    best, stopped = MD.best_round(fit.losses, 4)
    assert stopped and len(fit.trees) == len(fit.losses) < best + 4 + 3
    assert MD.boosted_model(fit, best).stages[-1].getNumTrees == best


def test_values_that_trees_cannot_take_are_named(rows):
    for bad, said in (({"a": F.when(F.col("id") == 4, F.lit(float("nan"))).otherwise(F.col("a"))}, "NaN or Infinity"),
                      ({"w": F.when(F.col("id") == 4, -1.0).otherwise(F.col("w"))}, "MUST NOT be Negative"),
                      ({"split": F.lit("validation")}, "no rows")):
        fit = MD.start_boosting(rows.withColumns(bad), FEATS, "y", held(), "w", **SMALL)
        with pytest.raises(Exception, match=said):
            MD.add_rounds(fit, 1)


def test_java_numbers(spark):
    x = np.concatenate([np.random.default_rng(2).normal(size=3000) * 9, [0.0, -0.0, 1e-10, -708.9, -745.0, 709.7, 710.0, np.inf, -np.inf]])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.exp("x")).orderBy("i").collect()
    assert [r[1] for r in got] == LT.java_exp(x).tolist()
    jvm = spark.sparkContext._jvm
    for seed in (42, -7, 2 ** 40 + 3):
        rng, draws = jvm.org.apache.spark.util.random.XORShiftRandom(seed), LT.XorShift(seed)
        assert [rng.nextDouble() for _ in range(5)] == [draws.double() for _ in range(5)]
        assert rng.nextInt() == draws.integer()
        assert jvm.java.util.Random(seed).nextLong() & (2 ** 64 - 1) == LT.JavaRandom(seed).long()


def test_order_of_a_scala_map(spark):
    """The weights of a column's values are added in the order of a Scala map, which tells equal gaps apart."""
    r = np.random.default_rng(4)
    v = np.unique(np.concatenate([r.normal(size=600), r.integers(-400, 400, 200), r.integers(1, 9, 20) * 2.0 ** -3, [3e9, -7e12, 1e17, 1e300, 0.1, 2.0 ** 40]]))
    found = getattr(getattr(spark.sparkContext._jvm.scala.collection.immutable, "HashMap$"), "MODULE$").empty()
    for x in r.permutation(v).tolist():
        found = found.updated(x, x)
    keys = found.keysIterator()
    assert [keys.next() for _ in range(len(v))] == v[LT.map_order(v)].tolist()
