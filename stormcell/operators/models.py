"""Models, blending and searches (M1-M14) on Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Mapping, Sequence
from uuid import uuid4

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import zero_div
from ..session import cut_lineage
from . import local_trees as LT
from . import metrics as M
from .alerts import require_columns
from .local_trees import LEAST_CURVE, MOST_STEP, best_round
from .quality import nan_to_num
from .series import Series
from .windows import rolling_fill_median

# Boosted-tree settings and the three blend members (min rows per leaf)
# (rate 0.1, 0.8 of rows and columns, up to 1000 rounds with early stopping, depth 7 ~ 127 leaves)
GBT_DEFAULTS = {"stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "maxIter": 1000,
                "maxDepth": 7, "seed": 42}
MEMBERS = {"model_precision": 30, "model_recall": 10, "model_balanced": 20}
PATIENCE = 50
SEARCH_TRIALS = 100
SEARCH_THRESHOLD = 0.5
# Ranges of the parameter search over boosted trees (20 trials)
SEARCH_SETTINGS = 20
SETTING_RANGES = {"stepSize": (0.03, 0.3), "maxDepth": [3, 4, 5, 6, 7], "minInstancesPerNode": [5, 10, 20, 30],
                  "subsamplingRate": [0.6, 0.8, 1.0], "featureSubsetStrategy": ["0.6", "0.8", "1.0"]}
FIRST_ROUNDS = 5         # rounds that every setting of a search gets
CHUNK = 10               # boosting rounds between two checkpoints of the margin
ROWS_PER_TASK = 50_000   # rows of a boosted fit per task
PARALLEL_FITS = 4        # fits that the driver has running side by side


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
            validation: str | None = None, **params) -> PipelineModel:
    """M1: gradient-boosted trees (depth-wise) with optional weights and early stopping on a
    validation indicator column."""
    p = {**GBT_DEFAULTS, **params}
    gbt = GBTClassifier(featuresCol="features", labelCol=label, **p)
    if weight:
        gbt.setWeightCol(weight)
    if validation:
        gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assembler(features), gbt]).fit(train)


def fit_gbt_patient(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
                    patience: int = PATIENCE, **params) -> PipelineModel:
    """M1 with early stopping around Spark's own classifier: training ends after ``patience`` rounds without a lower validation
    log-loss, and the best round is kept.  A boosted model's first n trees are those of a fit of n rounds with the same seed,
    so fits of 2, 4, 8 ... times ``patience`` rounds are judged round by round until the stop is seen (or ``maxIter`` is
    reached), and one fit of the best number of rounds is the result.  ``fit_patient`` does not refit."""
    p = {**GBT_DEFAULTS, **params}
    most = p.pop("maxIter")
    held = assembler(features).transform(val).select("features", F.col(label).cast("double").alias(label))
    rounds = min(most, 2 * patience)
    while True:
        model = fit_gbt(train, features, label, weight, maxIter=rounds, **p)
        keep, stopped = best_round(model.stages[-1].evaluateEachIteration(held), patience)
        if stopped or rounds == most:
            return model if keep == rounds else fit_gbt(train, features, label, weight, maxIter=keep, **p)
        rounds = min(most, 2 * rounds)


@dataclass
class Boosting:
    """A boosted fit that can be continued.  ``rows`` is a checkpointed table (features, label, weight, held, margin): the
    margin holds what the trees so far say, so more rounds never refit earlier ones.  ``losses`` are the validation log-losses.
    ``one_task``: the rows are one partition, whose rounds run in one task; ``trees`` are then the nodes as JSON."""

    rows: DataFrame
    features: list
    params: dict
    one_task: bool = False
    trees: list = field(default_factory=list)
    losses: list = field(default_factory=list)


def start_boosting(data: DataFrame, features: Sequence[str], label: str, held: Column, weight: str | None = None,
                   **params) -> Boosting:
    """Begin a boosted fit on the rows where ``held`` is false; the others are the validation rows.  The table is dealt
    into one task per ``ROWS_PER_TASK`` rows, so that small fits are not dominated by tasks."""
    rows = assembler(features).transform(data).select(
        "features", F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        F.coalesce(held, F.lit(False)).alias("held"), F.lit(0.0).alias("margin"))
    rows = cut_lineage(rows.where("label is not null and weight is not null"))
    tasks = max(1, -(-rows.count() // ROWS_PER_TASK))
    kinds = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    rows = cut_lineage(rows.repartition(tasks))
    return Boosting(rows, list(features), {**GBT_DEFAULTS, **params}, tasks == 1 and not set(kinds) - {"numeric"})


def fresh(fit: Boosting, **params) -> Boosting:
    """A fit that begins with the rows of ``fit``, which has no rounds yet, and other parameters."""
    return replace(fit, params={**fit.params, **params}, trees=[], losses=[])


def add_rounds(fit: Boosting, rounds: int, patience: int | None = None) -> None:
    """Fit ``rounds`` more trees, or fewer if ``patience`` rounds without a lower validation loss come before (looked for
    every ``CHUNK`` rounds)."""
    if fit.one_task:
        return _rounds_in_task(fit, rounds, patience)
    most = len(fit.trees) + rounds
    while len(fit.trees) < most and not (patience is not None and best_round(fit.losses, patience)[1]):
        _rounds_by_jobs(fit, min(CHUNK, most - len(fit.trees)))


_ROUNDS = "features array<double>, label double, weight double, held boolean, margin double, tree string, loss double"


def _rounds_in_task(fit: Boosting, rounds: int, patience: int | None) -> None:
    """``add_rounds`` on one partition: the rounds of ``_rounds_by_jobs``, tree by tree, without a job for each.  The task
    gives its rows with their new margin, then a row for each tree."""
    done, losses, p, boost, wide, chunk = len(fit.trees), list(fit.losses), dict(fit.params), LT.boost, len(fit.features), CHUNK

    def run(batches):
        import numpy as np
        import pyarrow as pa
        batches = [b for b in batches if b.num_rows]
        if not batches:
            raise ValueError("no rows to fit trees on")
        t = pa.Table.from_batches(batches).combine_chunks()
        x = np.ascontiguousarray(t.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, wide)
        label, weight, held, margin = (t.column(k).to_numpy() for k in range(1, 5))
        trees, new, margin = boost(x, label, weight, held, margin, done, losses, rounds, patience, chunk, p)
        schema = pa.schema([*t.schema, pa.field("tree", pa.string()), pa.field("loss", pa.float64())])
        for b in t.set_column(4, t.schema.field(4), pa.array(margin)).to_batches(max_chunksize=10_000):
            none = [pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *none], schema=schema)
        for tree, loss in zip(trees, new):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in t.schema), pa.array([tree]), pa.array([loss])], schema=schema)
    inputs = fit.rows.select(vector_to_array("features").alias("features"), *fit.rows.columns[1:])
    out = cut_lineage(inputs.mapInArrow(run, _ROUNDS))
    for r in out.where("tree is not null").select("tree", "loss").collect():
        fit.trees.append(r["tree"])
        fit.losses.append(r["loss"])
    fit.rows = out.where("tree is null").select(array_to_vector("features").alias("features"), *fit.rows.columns[1:])


def _rounds_by_jobs(fit: Boosting, rounds: int) -> None:
    """``add_rounds`` on many partitions, without patience: ``CHUNK`` rounds at a time between checkpoints of the margin.

    A round is a Newton step of the logistic loss: one regression tree on ``(y - p) / (p (1 - p))`` with the row weights
    times ``p (1 - p)``, so a leaf's mean is its step.  Validation losses of a chunk's rounds come from one aggregate."""
    p = fit.params
    done = 0
    while done < rounds:
        d, new = fit.rows.withColumn("_m0", F.col("margin")), []
        for k in range(min(CHUNK, rounds - done)):
            chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"_m{k}")))
            curve = F.greatest(chance * (1 - chance), F.lit(LEAST_CURVE))
            step = F.least(F.greatest((F.col("label") - chance) / curve, F.lit(-MOST_STEP)), F.lit(MOST_STEP))
            tree = RandomForestRegressor(
                featuresCol="features", labelCol="_z", weightCol="_w", numTrees=1, bootstrap=False, maxDepth=p["maxDepth"],
                minInstancesPerNode=p.get("minInstancesPerNode", 1), subsamplingRate=p["subsamplingRate"],
                featureSubsetStrategy=p["featureSubsetStrategy"], seed=p["seed"] + len(fit.trees) + k)
            fitted = tree.fit(d.where(~F.col("held")).select("features", step.alias("_z"), (F.col("weight") * curve).alias("_w")))
            new.append(fitted.trees[0])
            d = (fitted.trees[0].setPredictionCol("_t").transform(d)
                 .withColumn(f"_m{k + 1}", F.col(f"_m{k}") + F.lit(float(p["stepSize"])) * F.col("_t")).drop("_t"))
        loss = [F.avg(F.log1p(F.exp(F.when(F.col("label") > 0.5, -F.col(f"_m{k}")).otherwise(F.col(f"_m{k}"))))).alias(f"l{k}")
                for k in range(1, len(new) + 1)]
        got = d.where("held").agg(*loss).first()
        fit.losses += [float("inf") if x is None else float(x) for x in got]
        fit.rows = cut_lineage(d.select(*fit.rows.columns[:-1], F.col(f"_m{len(new)}").alias("margin")))
        fit.trees += new
        done += len(new)


def _node_reader(jvm):
    """Makes Spark ML's regression tree of its nodes as JSON (one call for a tree, not one for each node)."""
    jackson = jvm.com.fasterxml.jackson
    mapper = jackson.databind.json.JsonMapper()
    mapper.registerModule(getattr(getattr(jackson.module.scala, "DefaultScalaModule$"), "MODULE$"))
    mapper.configure(jackson.core.json.JsonReadFeature.ALLOW_NON_NUMERIC_NUMBERS.mappedFeature(), True)
    saved = getattr(getattr(jvm.org.apache.spark.ml.tree, "DecisionTreeModelReadWrite$"), "MODULE$")
    nodes = jvm.java.lang.Class.forName("[Lorg.apache.spark.ml.tree.DecisionTreeModelReadWrite$NodeData;", True,
                                        jvm.java.lang.Thread.currentThread().getContextClassLoader())

    def read(tree: str, width: int):
        return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(
            f"dtr_{uuid4().hex[:12]}", saved.buildTreeFromNodes(mapper.readValue(tree, nodes), "variance"), width)
    return read


def boosted_model(fit: Boosting, keep: int | None = None) -> PipelineModel:
    """The first ``keep`` trees as an ordinary Spark ML pipeline (assembler, boosted-tree classifier)."""
    trees = fit.trees[:keep]
    sc = fit.rows.sparkSession.sparkContext
    jvm = sc._jvm
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    found, weights = sc._gateway.new_array(kind, len(trees)), sc._gateway.new_array(jvm.double, len(trees))
    read = _node_reader(jvm)
    for i, t in enumerate(trees):
        found[i] = read(t, len(fit.features)) if fit.one_task else t._java_obj
        weights[i] = float(fit.params["stepSize"]) / 2  # the classifier's probability is 1 / (1 + exp(-2 margin))
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"boosted_{uuid4().hex[:12]}", found, weights,
                                                                         len(fit.features), 2)
    return PipelineModel([assembler(fit.features), GBTClassificationModel(java)])


@dataclass
class PatientFit:
    """Result of ``fit_patient``: the model of the best round, that round, the round training ended at, and the losses."""

    model: PipelineModel
    best: int
    ended: int
    losses: list


def fit_patient(data: DataFrame, features: Sequence[str], label: str, held: Column, weight: str | None = None,
                patience: int = PATIENCE, **params) -> PatientFit:
    """M1 with early stopping: boosting ends once ``patience`` rounds bring no lower validation log-loss (or at ``maxIter``
    rounds), and the trees up to the best round are the model.  No tree is fitted twice."""
    return _patient(start_boosting(data, features, label, held, weight, **params), patience)


def _patient(fit: Boosting, patience: int) -> PatientFit:
    add_rounds(fit, fit.params["maxIter"], patience)
    keep = best_round(fit.losses, patience)[0]
    return PatientFit(boosted_model(fit, keep), keep, min(keep + patience, len(fit.trees)), fit.losses)


def fit_members(data: DataFrame, features: Sequence[str], label: str, held: Column, members: Mapping[str, int] = MEMBERS,
                weight: str | None = None, patience: int = PATIENCE, **params) -> dict[str, PatientFit]:
    """M2: the members differ in minimum rows per leaf; each stops early on the held rows.  They are fitted side by side
    from one prepared checkpoint."""
    start = start_boosting(data, features, label, held, weight, **params)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        jobs = {k: pool.submit(_patient, fresh(start, minInstancesPerNode=m), patience) for k, m in members.items()}
        return {k: j.result() for k, j in jobs.items()}


def score(df: DataFrame, model: PipelineModel, name: str = "p") -> DataFrame:
    """A2: probability of the positive class as a double column; missing inputs are named before any job runs (A1)."""
    require_columns(df, model.stages[0].getInputCols())
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability",
                                                                        "prediction")


def normalise(weights: Mapping[str, float]) -> dict[str, float]:
    """M3: weights scaled to sum 1; a zero sum is rejected."""
    tot = float(sum(weights.values()))
    if tot <= 0:
        raise ValueError("blend weights must have a positive sum")
    return {k: float(v) / tot for k, v in weights.items()}


def blend_expr(weights: Mapping[str, float]) -> Column:
    """M4: weighted sum of member probabilities."""
    w = normalise(weights)
    expr = None
    for c, v in w.items():
        term = F.lit(v) * F.col(c)
        expr = term if expr is None else expr + term
    return expr


def blend(df: DataFrame, weights: Mapping[str, float], name: str = "blend") -> DataFrame:
    return df.withColumn(name, blend_expr(weights))


def mean_blend(df: DataFrame, cols: Sequence[str], name: str = "mean_score") -> DataFrame:
    """M5: plain mean of the scores."""
    return df.withColumn(name, sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols))))


def trial_weights(n: int = SEARCH_TRIALS, k: int = 3, seed: int = 42) -> list[list[float]]:
    """Seeded uniform [0,1]^k trial weights (parameters of the search, not data)."""
    rng = np.random.default_rng(seed)
    return rng.uniform(0.0, 1.0, size=(n, k)).round(6).tolist()


def search_weights(val: DataFrame, cols: Sequence[str], y: str, trials: Sequence[Sequence[float]],
                   t: float = SEARCH_THRESHOLD) -> DataFrame:
    """M7: F1 at ``t`` of every weight trial on the validation rows, one job.

    A task adds up the counts of all its rows for all trials as arrays and gives one row per trial; no row is made
    per trial and input row.  Returns one row per trial, best first is ``orderBy(desc('f1'), 'trial').limit(1)``.
    """
    w = np.array(trials, float).reshape(len(trials), -1)
    # sums in the order of the columns, as the blend itself adds them
    total = sum((w[:, j] for j in range(w.shape[1])), np.zeros(len(w)))
    wide = [F.col(y).cast("int").alias("_y"), *[F.col(c).cast("double").alias(f"_c{j}") for j, c in enumerate(cols)]]

    def count(batches):
        import numpy as np
        import pyarrow as pa
        tp, fp, fn = (np.zeros(len(w), np.int64) for _ in range(3))
        for b in batches:
            yy = b.column(0).to_pandas().to_numpy(float)
            x = [b.column(j + 1).to_pandas().to_numpy(float) for j in range(w.shape[1])]
            for k in range(len(w)):
                if total[k] == 0:
                    continue
                mix = sum((w[k, j] * x[j] for j in range(w.shape[1])), np.zeros(len(yy))) / total[k]
                hit, known = mix >= t, ~np.isnan(mix)
                tp[k] += np.count_nonzero((yy == 1) & hit)
                fp[k] += np.count_nonzero((yy != 1) & ~np.isnan(yy) & hit)
                fn[k] += np.count_nonzero((yy == 1) & ~hit & known)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), pa.array(tp), pa.array(fp), pa.array(fn)],
                                         names=["trial", "tp", "fp", "fn"])
    parts = val.select(*wide).mapInArrow(count, "trial int, tp long, fp long, fn long")
    g = parts.groupBy("trial").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = zero_div(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn"))
    wt = F.array(*[F.struct(F.lit(i).alias("trial"), *[F.lit(float(w)).alias(f"w{j}") for j, w in enumerate(ws)])
                   for i, ws in enumerate(trials)])
    g = g.withColumn("f1", f1)
    tw = val.sparkSession.range(1).select(F.explode(wt).alias("x")).select("x.*")
    return g.join(F.broadcast(tw), on="trial")  # trials table: len(trials) rows


def blend_flow(df: DataFrame, cols: Sequence[str], y: str, split: str, trials: Sequence[Sequence[float]],
               t: float = SEARCH_THRESHOLD, name: str = "blend") -> tuple[DataFrame, dict]:
    """M7, M3, M4, E12, E1 and E2 in one flow: the trial with the best F1 on the validation split (ties: the first) is
    normalised and applied, its threshold with the best F1 chosen on the validation split, and every split scored
    at that threshold.  Returns (rates per split with the threshold, the weights); the driver sees one trial and one
    threshold."""
    val = df.where(F.col(split) == "validation")
    best = search_weights(val, cols, y, trials, t).orderBy(F.desc("f1"), "trial").first()
    if best is None:
        raise ValueError("the validation split has no rows")
    weights = normalise({c: best[f"w{j}"] for j, c in enumerate(cols)})
    scored = df.withColumn(name, F.floor(blend_expr(weights) * 1e6 + 0.5) / 1e6)  # scores of 6 decimals
    curve = M.pr_curve(scored.where(F.col(split) == "validation"), y, name).where("threshold is not null")
    cut = curve.orderBy(F.desc("f1"), "threshold").first()["threshold"]
    called = scored.withColumn("called", (F.col(name) >= F.lit(cut)).cast("int"))
    rates = M.confusion(called, y, "called", [split]).withColumns({"trial": F.lit(best["trial"]), "threshold": F.lit(cut)})
    return rates, weights


def search_settings(n: int = SEARCH_SETTINGS, seed: int = 42) -> list[dict]:
    """``n`` settings of the boosted trees drawn with a seed from the ranges of ``SETTING_RANGES`` (parameters, not data)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        lo, hi = SETTING_RANGES["stepSize"]
        one = {"stepSize": round(float(np.exp(rng.uniform(np.log(lo), np.log(hi)))), 4)}
        one |= {k: v[int(rng.integers(len(v)))] for k, v in SETTING_RANGES.items() if k != "stepSize"}
        out.append(one)
    return out


def _held_auc(fit: Boosting) -> float:
    """AUC of the margin on the validation rows; no rank if one class is missing."""
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="margin", metricName="areaUnderROC")
    return float(ev.evaluate(fit.rows.where("held").select("label", "margin")))


def search_params(data: DataFrame, features: Sequence[str], label: str, held: Column, settings: Sequence[Mapping[str, object]],
                  weight: str | None = None, first_rounds: int = FIRST_ROUNDS, patience: int = PATIENCE) -> DataFrame:
    """M8: successive halving over the settings by validation AUC.

    All settings start with ``first_rounds`` rounds; the better half goes on from its margins with twice the rounds, until
    one is left, which is trained to its early stop (or ``maxIter``).  All read one prepared checkpoint, and those of a
    step are fitted side by side.  One row per setting: its parameters, AUC, the rounds it was given, the step in which
    it was dropped (null: the last one), and its best round by log-loss."""
    start = start_boosting(data, features, label, held, weight)
    fits = {i: fresh(start, **p) for i, p in enumerate(settings)}
    auc, dropped, live, rounds, step = {}, {}, list(fits), first_rounds, 1
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        while len(live) > 1:
            list(pool.map(lambda i: add_rounds(fits[i], min(rounds, fits[i].params["maxIter"]) - len(fits[i].trees)), live))
            auc |= dict(zip(live, pool.map(lambda i: _held_auc(fits[i]), live)))
            ranked = sorted(live, key=lambda i: (-auc[i], i))
            live = ranked[:-(-len(ranked) // 2)] if len(ranked) > 1 else ranked
            dropped |= {i: step for i in ranked[len(live):]}
            rounds, step = 2 * rounds, step + 1
    for i in live:
        fit = fits[i]
        add_rounds(fit, fit.params["maxIter"] - len(fit.trees), patience)
        auc[i] = _held_auc(fit)
    rows = [(i, json.dumps(dict(p), sort_keys=True), auc[i], len(fits[i].trees), dropped.get(i), best_round(fits[i].losses, patience)[0])
            for i, p in enumerate(settings)]
    return data.sparkSession.createDataFrame(
        rows, "trial int, params string, val_auc double, rounds int, dropped_at int, best_round int")


def importance(model: PipelineModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """M9: normalised importances by feature, descending."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = SparkSession.getActiveSession().createDataFrame(list(zip(features, imp)), "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def save_bundle(path: str, models: Mapping[str, PipelineModel], meta: Mapping[str, object]) -> None:
    """Spark ML directories per member plus one JSON metadata document (written by Spark)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/_meta")


def load_bundle(path: str, names: Sequence[str]) -> tuple[dict[str, PipelineModel], dict]:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    models = {n: PipelineModel.load(f"{path}/{n}") for n in names}
    meta = json.loads(spark.read.text(f"{path}/_meta").first()["value"])
    return models, meta


def meta_features(df: DataFrame, s: Series, p: str, cols: Sequence[str]) -> DataFrame:
    """Stacking inputs p, |p - 0.5|, rolling means (24 rows, median fill) of two columns,
    cleaned with nan_to_num (missing -> 0.5, +inf -> 1, -inf -> 0)."""
    d = df.withColumns({"meta_p": F.col(p).cast("double"), "meta_conf": F.abs(F.col(p) - F.lit(0.5))})
    d = rolling_fill_median(d, s, list(cols)[:2], 24, suffix="_roll24")
    outs = ["meta_p", "meta_conf", *[f"{c}_roll24" for c in list(cols)[:2]]]
    return nan_to_num(d, outs, nan=0.5, posinf=1.0, neginf=0.0)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0,
                 weight: str | None = None) -> PipelineModel:
    """L2 logistic regression, C = 1, class-balanced weights, no standardisation."""
    wsum = df.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * float(wsum)),
                            elasticNetParam=0.0, standardization=False, maxIter=200)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[assembler(features), lr]).fit(df)


def row_mean(df: DataFrame, cols: Sequence[str], name: str = "row_mean", n: int = 5) -> DataFrame:
    """Mean of the first ``n`` columns per row (missing -> 0 afterwards)."""
    use = list(cols)[:n]
    total = sum((F.col(c) for c in use), F.lit(0.0)) / F.lit(float(len(use)))
    return df.withColumn(name, F.coalesce(total, F.lit(0.0)))


def latest(spark, path: str, prefix: str) -> str | None:
    """Newest file by sorted name under ``path`` (a listing read by Spark)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(path) \
        .select(F.element_at(F.split("path", "/"), -1).alias("name"))
    row = files.agg(F.max("name")).first()
    return row[0] if row else None


def latest_folder(spark, path: str) -> str | None:
    """M14 for results that are folders: newest folder by sorted name under ``path`` (from the paths of its files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = files.select(F.max(F.element_at(F.split("path", "/"), -2))).first()
    return row[0] if row else None
