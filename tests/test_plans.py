"""What the plans must and must not hold."""

import pytest
from __spark_entry__ import registry
from hearsay.operators import ranks, series, words
from hearsay.plans import inputs

FOLDER = "/root/testdata/sf0.001"
# Streams, sinks and ranks over the whole table run jobs of their own while they are built.
PLANNED = [
    name for name in sorted(registry())
    if not name.startswith(("stream_", "json_", "global_")) and not name.endswith(("_bucketed", "_in_place")) and "S1" not in registry()[name].items
    and name not in {"dual_sink", "csv_export", "malformed_lines", "compacted_posts", "converted_format",
                            "runs_recorded"}
]
PYTHON = {"running_totals", "global_row_numbers", "model_scores", "model_labels", "embedded_texts", "nearest_vectors",
          "nearest_vectors_blocked", "retrieved_texts"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(registry()[name].run(spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan


def test_scans_read_only_what_is_used(spark):
    events = inputs.table(spark, FOLDER, "events")
    plan = plan_of(series.ingestion_metrics(series.labelled(events, "ts", "x")))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan
    plan = plan_of(registry()["valid_year"].run(spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_words_are_combined_before_the_shuffle(spark):
    docs = inputs.table(spark, FOLDER, "documents")
    plan = plan_of(words.posts_per_word(docs, "text"))
    assert plan.index("HashAggregate") < plan.index("partial_count") and "Generate explode" in plan


@pytest.mark.parametrize("name", ["popular_words", "series_for_top", "latest_word_scores"])
def test_batch_groups_hold_the_start_of_a_window_alone(spark, name):
    plan = plan_of(registry()[name].run(spark, FOLDER))
    grouped = [line for line in plan.split("\n") if "HashAggregate(keys=[" in line]
    assert any("__start" in line for line in grouped) and not any("window#" in line for line in grouped)


def final_plan(frame):
    """The plan that ran, without the initial plans printed beside it."""
    frame.collect()
    lines, hidden = [], None
    for line in plan_of(frame).split("\n"):
        depth = len(line) - len(line.lstrip(" :|+-"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth - 1 if "== Initial Plan ==" in line else None
        if hidden is None:
            lines.append(line)
    return "\n".join(lines)


@pytest.mark.parametrize("name", ["popular_words", "declining_words"])
def test_ranking_and_series_share_an_exchange(spark, name):
    plan = final_plan(registry()[name].run(spark, FOLDER))
    assert plan.count("Generate explode(") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["sentiment_heatmap", "dying_trends", "saturation_timeline", "word_timeline_top"])
def test_texts_are_read_once(spark, name):
    """Ranking words and giving their series must not tokenize twice."""
    plan = final_plan(registry()[name].run(spark, FOLDER))
    assert plan.count("regexp_extract_all") == 1 and "ReusedExchange" in plan


def test_global_row_numbers_shuffle_rows_once(spark):
    orders = inputs.table(spark, FOLDER, "orders")
    plan = plan_of(ranks.global_order(orders, "o_totalprice", "o_orderkey"))
    # What is dealt by partition number are the counts of the partitions, not the rows.
    assert "row_number" not in plan.replace("row_number#", "") and plan.count("hashpartitioning(__part") == 1
    assert "partial_count" in plan[plan.index("hashpartitioning(__part"):]


def test_running_sums_do_not_deal_rows_again(spark):
    """Rows are range-partitioned once, before the checkpoint; afterwards only sums are dealt, and
    no window sees the rows."""
    orders = inputs.table(spark, FOLDER, "orders")
    for frame in (
        ranks.global_order(orders, "o_totalprice", "o_orderkey", "o_totalprice"),
        ranks.running_total(orders, "o_custkey", ["o_orderkey"], "o_totalprice"),
        series.sample_series(orders, "o_orderkey", 10),
    ):
        plan = plan_of(frame)
        side = plan[:plan.index("BroadcastExchange")] + plan[plan.rindex("BroadcastExchange"):].split("BroadcastExchange")[0]
        assert "Exchange" not in side.replace("BroadcastExchange", "") and "Window" not in side
        assert "partial_" in plan[plan.index("BroadcastExchange"):]


@pytest.mark.parametrize("name", ["sentiment_heatmap", "dying_trends", "word_timeline_top"])
def test_lists_are_made_for_the_top_words_only(spark, name):
    plan = registry()[name].run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.rindex("GlobalLimit")
    assert "collect_list" in plan[:top] and "collect_list" not in plan[top:]


def test_top_k_is_not_a_full_sort(spark):
    plan = plan_of(registry()["top_keywords"].run(spark, FOLDER))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_every_query_names_its_operators():
    assert all(query.items for query in registry().values())
    assert not [name for name in registry() if name.startswith("op") or name == "pipeline"]
