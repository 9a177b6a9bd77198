"""Physical plans: pruned scans, pushed filters, no products of tables, no Python in relational queries."""

import pytest

from tracklane.plans import catalog, context_queries, label_queries, profile_queries, rel_queries, report_queries, stat_queries, table_queries, track_queries

SF = "/root/testdata/sf0.001"
RELATIONAL = [n for m in (context_queries, label_queries, rel_queries, stat_queries, table_queries, track_queries, profile_queries, report_queries) for n in m.ORACLE_SQL]


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_products_and_no_python(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text


def test_scans_read_what_is_used(spark):
    text = plan(spark, "semi_filter")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "LessThan(c_acctbal,0.0)" in text.replace(" ", "") or "LessThan(c_acctbal,0" in text
    text = plan(spark, "conditional_aggregates")
    assert "l_extendedprice" not in text and "l_shipdate" not in text
    assert "l_comment" not in text and "partial_sum" in text


def test_first_rows_are_combined_before_the_shuffle(spark):
    text = plan(spark, "entity_dedup_keep_first")
    assert "Window" not in text and "partial_min" in text


@pytest.mark.parametrize("name", ["velocities", "help_events", "dense_pivot", "breakdown_runs", "closeouts_matched", "corner_help", "matchup_viterbi", "matchup_viterbi_help", "phase_shares", "phase_shares_by_defender"])
def test_possessions_stay_in_their_task(spark, name):
    """Keys are dealt before they grow to frames; what is made of a possession is not moved again."""
    text = plan(spark, name)
    assert "hashpartitioning(possession" not in text
    assert "hashpartitioning(o_orderkey" in text


def test_sampled_lines_move_once(spark):
    """Lines are dealt before they are repeated for the repetitions; only the ranked ones, at most 40 of a unit's half, move again."""
    text = plan(spark, "stability_curve")
    assert "Window" in text and "hashpartitioning(rep" not in text


def test_shots_are_dealt(spark):
    """One small file of keys is not one task."""
    from tracklane.plans import report_queries

    assert report_queries._shot_table(spark, SF).rdd.getNumPartitions() > 1


def test_phases_meet_possessions_before_steps(spark):
    """Intervals are joined to possessions as one row each: no join, and so no sort, lies above the growth to steps; both variants read steps once, and the league's sums are taken only where differences are."""
    from tracklane.operators import defence

    text = context_queries._phased(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= text.index("Generate") < text.index("Join") and "Union" not in text
    shares = defence.phase_shares(spark.createDataFrame([(1, "help"), (2, "other")], "d long, phase string"), ["d"])
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in planned(shares) and "Subquery" not in planned(shares.select("d", "help"))


def test_frames_are_not_broadcast(spark):
    """Frames are many times what the keys' file lets Spark expect; they meet the times asked for where they are made."""
    text = plan(spark, "features_at_times")
    assert "BroadcastExchange" not in text and "hashpartitioning(possession" not in text
    assert "hashpartitioning(o_orderkey" in text


def test_shots_are_made_once(spark):
    """Points against draws read staged shots: frames are not grown again, and features are not made of whole court positions."""
    text = plan(spark, "learned_points")
    assert "MapInArrow" in text and "Generate" not in text and "Exchange hashpartitioning(o_orderkey" not in text


def test_splits_are_told_apart_before_chains(spark):
    """Possessions of the other split are not worked on, and a possession's errors leave its task as one sum."""
    text = plan(spark, "rule_left_over")
    assert text.index("MapInArrow") < text.index("% 5")
    assert "square" in text and "slot" not in text
