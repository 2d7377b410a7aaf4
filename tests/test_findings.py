"""Cases that earlier gave a wrong or incomplete result without an error."""

import os

from pyspark.sql import functions as F

from itemscope.operators.anchors import kmeans_anchors
from itemscope.operators.irt import _orient
from itemscope.operators.regress import _alpha_name
from itemscope.sources.io import cached_stage, stage_key
from itemscope.streaming.incremental import pds_stream


def test_more_anchors_than_items(spark):
    items = spark.createDataFrame([(i, i, "s", 1.0) for i in range(3)], "item_id long, item_pos long, scenario string, bal_w double")
    features = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "item_id long, vec array<double>")
    got = kmeans_anchors(features, items, [2, 5])
    n = {r.n_items: (r.c, round(r.w, 6)) for r in got.groupBy("n_items").agg(F.count("*").alias("c"), F.sum("weight").alias("w")).collect()}
    assert n[5] == (3, 1.0) and n[2] == (2, 1.0)


def test_half_written_stage_is_rebuilt(spark, tmp_path):
    root = str(tmp_path)
    path = f"{root}/s/{stage_key(k=1)}"
    cached_stage(spark, root, "s", lambda: spark.range(100).repartition(4), k=1)
    os.remove(f"{path}/_SUCCESS")
    os.remove(next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")))
    assert cached_stage(spark, root, "s", lambda: spark.range(100), k=1).count() == 100
    assert cached_stage(spark, root, "s", lambda: 1 / 0, k=1).count() == 100


def test_ragged_answers(spark):
    df = spark.createDataFrame([(1, 1, [0.9]), (2, 1, [0.2, 0.8, 0.1])], "model_id long, item_id long, probs array<double>")
    r = pds_stream(df, 3).first()
    assert (r.pmax_0, r.pmax_1, r.pmax_2, r.n_rows) == (0.9, 0.8, 0.1, 2)


def test_orient_flips_both(spark):
    items = spark.createDataFrame([(1, [-2.0], [0.5])], "item_id long, a array<double>, b array<double>")
    abil = spark.createDataFrame([(1, [1.5])], "model_id long, theta array<double>")
    i, a = _orient(items, abil, 1)
    assert i.first().a == [2.0] and a.first().theta == [-1.5]


def test_penalty_names():
    assert [_alpha_name(x) for x in (0.1, 10.0, 5e-6, 1e-4)] == ["01", "10", "5e-6", "e-4"]
