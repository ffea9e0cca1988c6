"""Plan shape: pruning and pushdown reach the scans; no cartesian products; skew-safe partitioning."""
import pytest

import __spark_entry__ as E
from arrearscope.plans.catalog import load_all
from conftest import SF_SMALL

SKIP = {"thompson_pick", "train_forests", "train_gbt", "score_portfolio", "train_uplift", "uplift_score",
        "permutation_importance", "importance_order", "kmeans_segments", "model_io", "embed_chunks",
        "vector_topk_lsh", "vector_topk_ivf", "ivf_recall", "node_table_scores", "node_table_uplift", "model_io_same",
        "kmeans_nearest", "bandit_carried", "chunk_json_roundtrip", "training_csv_export", "embedding_table_io"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_and_pushes_down(spark):
    p = plan(E.entry(spark))
    assert "TakeOrderedAndProject" in p
    assert "EqualTo(l_returnflag,R), LessThan(l_shipdate," in p
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double,c_mktsegment:string>" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>" in p
    # contacts are not used by the flagship: the left join to the (unique-key) event aggregate is removed
    assert "events.parquet" not in p


def test_contacts_filter_reaches_scan(spark):
    p = plan(E.queries()["portfolio_scan"](spark, SF_SMALL))
    assert "In(event_type, [click,error,view])" in p and "GreaterThanOrEqual(ts," in p


@pytest.mark.parametrize("key", sorted(k for k in load_all() if k not in SKIP and not k.startswith("stream_")))
def test_no_cartesian_products(spark, key):
    p = plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


def test_trailing_window_partitions_by_user_and_hour(spark):
    p = plan(E.queries()["contacts_trailing_7d"](spark, SF_SMALL))
    assert "_b#" in p and "hashpartitioning(user_id" in p
    # no window is keyed by the customer alone except the per-user bucket-offset prefix sum
    assert "Window [" in p


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    code = ("import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql(); "
            "assert set(s) <= set(q) and len(q) >= 100")
    r = subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parents[1]),
                       capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]


def test_reports_prune_and_push_down(spark):
    from arrearscope.plans.report_queries import advanced
    p = plan(advanced(spark, SF_SMALL).where("c_custkey = 5").select("customer_id", "segment"))
    assert "EqualTo(c_custkey,5)" in p and "Scan ExistingRDD" not in p and "InMemoryTableScan" not in p
    # no segment asked for: no label work
    free = plan(E.queries()["kpi_advanced"](spark, SF_SMALL))
    assert "map_from_entries" not in free and "Subquery" not in free
