"""Rounds of a fit are dealt to every core, whatever a small table's size on disk."""

import numpy as np

from itemscope.operators import anchors, irt_fit


def test_a_fit_has_a_bucket_for_every_core():
    assert irt_fit._buckets(1_000_000, 12) == 12
    assert irt_fit._buckets(30_000, 12) == 2 and irt_fit._buckets(0, 12) == 1
    assert irt_fit._buckets(100_000_000, 12) == 400


def test_blocks_of_a_small_table_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_ITEMS", 8)
    points = spark.createDataFrame([("", "s", i, i, 1 / 64, [float(i)]) for i in range(64)],
                                   "split_id string, scenario string, item_id long, item_pos long, nbw double, vec array<double>")
    blocks = anchors._dealt(anchors._blocks(points))
    assert blocks.count() == 8
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(i for r in blocks.collect() for i in r.item_id) == list(range(64))


def test_assigned_equals_differences():
    r = np.random.default_rng(4)
    unknown = (r.random((300, 9)) < 0.5).astype(float)
    unknown[7, 2] = np.nan
    for x in ((r.random((300, 9)) < 0.5).astype(float), r.normal(size=(300, 5)), unknown):
        for size in (1, 2, 30):
            centres = np.concatenate([x[:1], x[8:20], x[8:20], x[20:80]])[:size]
            want, _ = anchors._reassign(x, centres, None, None)
            at, far, away = anchors._assigned(x, (x * x).sum(1), centres)
            assert (at == want["at"]).all()
            assert far == want["upper"].argmax() and (away == want["upper"][far] or np.isnan(away))
