"""Plans of the pair joins and of plain column rules."""

import pytest

from pagestrata.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["assign_owner", "overlap_edges", "outside_bubbles", "attach_evidence", "sanitize_regions"])
def test_pair_joins_have_equal_keys(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "__cx" in text


@pytest.mark.parametrize("name", ["box_normalize", "region_order", "filter_ocr_text", "term_usage", "init_translation", "page_status", "export_manifest", "masked_pixels", "trim_repeated_suffix", "flatten_ocr_output"])
def test_column_rules_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Arrow" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "run_result")
    assert "props" not in text and "value" not in text.split("ReadSchema")[1]
