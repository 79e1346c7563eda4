"""Sinks, file sizes, CSV, model bundle save/load and latest-file lookup."""

import os
import tempfile

from pyspark.sql import functions as F

from stormcell.operators import models as MD
from stormcell.sources import files as SRC

from conftest import SF_SMALL


def test_parquet_csv_json_and_sizes(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    SRC.write_parquet(li.withColumn("y", F.year("l_shipdate")), os.path.join(base, "pq"), partition_by=["y"])
    sizes = SRC.file_sizes(spark, os.path.join(base, "pq")).first()
    assert sizes["files"] >= 7 and sizes["bytes"] > 0
    SRC.write_csv(li.select("l_orderkey", "l_quantity"), os.path.join(base, "csv"))
    back = SRC.read_csv(spark, os.path.join(base, "csv"), "l_orderkey long, l_quantity double")
    assert back.count() == li.count()
    SRC.write_json(li.limit(5), os.path.join(base, "json"))
    assert spark.read.json(os.path.join(base, "json")).count() == 5
    info = SRC.inspect(li, ["price"])
    assert info["matches"]["price"] == ["l_extendedprice"]


def test_model_bundle_and_latest(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    d = emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)],
                   (F.col("label") >= 5).cast("int").alias("y"))
    feats = [f"e{i}" for i in range(4)]
    m = MD.fit_gbt(d, feats, "y", maxIter=3, maxDepth=2)
    MD.save_bundle(os.path.join(base, "bundle_20250101"), {"m": m}, {"features": feats, "weights": {"m": 1.0}})
    MD.save_bundle(os.path.join(base, "bundle_20250202"), {"m": m}, {"features": feats, "weights": {"m": 1.0}})
    models, meta = MD.load_bundle(os.path.join(base, "bundle_20250202"), ["m"])
    assert meta["features"] == feats
    p = MD.score(d, models["m"]).select("p").toPandas()["p"]
    assert ((p >= 0) & (p <= 1)).all()
    imp = MD.importance(m, feats).toPandas()
    assert abs(imp["importance"].sum() - 1.0) < 1e-9
    name = MD.latest(spark, os.path.join(base, "bundle_20250202", "_meta"), "part-")
    assert name.startswith("part-")
