"""Plan-level guarantees of the main queries (read from ``explain``)."""

import contextlib
import io

import pytest

from itemscope.plans import queries as q
from tests.conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


MAIN = ["flagship_pds_naive_mae", "pds_scores", "jsd_scores", "guided_pds", "threshold_search",
        "top_disagreement_stratified", "low_disagreement_stratified", "top_disagreement_global",
        "random_stratified", "naive_estimate", "knn_estimate", "nearest_anchor_weights",
        "mae_leaderboard", "spearman", "sparse_true_accuracy", "unseen_items"]


@pytest.mark.parametrize("name", MAIN)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(q.REGISTRY[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["top_disagreement_stratified", "top_disagreement_global",
                                  "random_stratified"])
def test_topk_is_cut_map_side(spark, name):
    plan = _plan(q.REGISTRY[name](spark, SF001))
    head = plan.split("\n\n")[0]
    # one WindowGroupLimit before the exchange (partial) and one after (final)
    assert head.count("WindowGroupLimit") >= 2


def test_softmax_exponentials_once_per_element(spark):
    plan = _plan(q.REGISTRY["pds_scores"](spark, SF001))
    # the row max and the exp sum are HOF arguments, never inside a lambda body
    assert "lambdafunction(EXP((lambda x" in plan
    assert "array_max(transform" not in plan
    # no inferred size() > 0 filter re-evaluating the softmax
    assert "size(zip_with" not in plan


def test_scans_are_pruned(spark):
    from itemscope.sources import fixtures as fx
    plan = _plan(fx.f2_log(spark, SF001))
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    lineitem = [sch for sch in schemas if "l_partkey" in sch][0]
    # 4 of lineitem's 11 columns reach the reader
    assert lineitem.split("struct<", 1)[1].count(":") == 4 and "l_extendedprice" not in lineitem
    part = [sch for sch in schemas if "p_partkey" in sch][0]
    assert "p_name" not in part and "p_retailprice" not in part
