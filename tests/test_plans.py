"""Plan shape: the properties that matter at scale, read from the physical plan."""

from pyspark.sql import functions as F

from tessera.operators import posts as P
from tessera.operators import stats as T


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _before_first_exchange(plan: str) -> str:
    """Operators under the first (lowest) Exchange of a tree string."""
    lines = plan.splitlines()
    idx = max(i for i, ln in enumerate(lines) if "Exchange" in ln)
    return "\n".join(lines[idx:])


def test_anova_partially_aggregates_raw_rows(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    long = li.select(F.col("l_returnflag").alias("cluster"), "l_quantity", "l_tax").unpivot(
        ["cluster"], ["l_quantity", "l_tax"], "feature_id", "value")
    plan = _plan(T.one_vs_rest_anova(long))
    low = _before_first_exchange(plan)
    assert "partial_" in low                        # map-side combine before the raw rows shuffle
    assert "l_quantity" in plan and "l_extendedprice" not in plan   # column pruning


def test_spearman_counts_cells_before_shuffle(spark):
    rows = [(f"p{i}", f"f{j}", float((i * j) % 4)) for i in range(50) for j in range(4)]
    plan = _plan(T.pair_cells(spark.createDataFrame(rows, "id string, f string, v double")))
    assert "partial_count" in plan and ("SortMergeJoin" in plan or "BroadcastHashJoin" in plan)


def test_questionnaire_stage_holds_no_text(spark):
    from tessera.plans import jobs as J
    assert "text" not in J.questionnaire(spark, "/root/testdata/sf0.001").columns
    assert "text" in J.flagged_texts(spark, "/root/testdata/sf0.001").columns


def test_one_per_group_is_a_partial_aggregate(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    plan = _plan(P.one_per_group(df, "g", "k"))
    assert "partial_min" in plan and "Window" not in plan


def test_fixture_scan_prunes_and_pushes(spark):
    from tessera.plans import jobs as J
    from tessera.plans import fixtures as fx
    df = fx.fx_rating_responses(J.flagged_posts(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(any_flag), EqualTo(any_flag,1)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,id:string,any_flag:int>" in plan
