"""What the plans of queries over reports must not do: move rows of a report twice, or repeat what a page is read by."""

import re

import pytest

from cinderlens import registry

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dominator_rows", "dominator_refs", "loaded_classes", "top_components_fallback", "local_variables", "suspect_split", "suspect_whole_page", "html_sections", "section_prune", "gdb_heads"])
def test_rows_of_a_report_move_once(spark, name):
    assert plan(registry.queries()[name](spark, FOLDER)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("name", "pattern"), [("dominator_rows", r"\bOnly\s+object\b"), ("loaded_classes", r"\bOnly\s+object\b"), ("top_components_fallback", r"\bOnly\s+object\b"), ("leak_rules", "app\\.n1\\b")])
def test_names_are_read_once_a_row(spark, name, pattern):
    text = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(pattern) == 1


def test_pages_of_references_are_made_without_pairs(spark):
    from cinderlens.operators import references

    assert "Join" not in plan(references._pages(spark, FOLDER))


@pytest.mark.parametrize("name", ["search_keyword", "search_keyword_least", "context_pack"])
def test_cells_of_words_move_by_block_and_not_once_for_each_query(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert "hashpartitioning(block" in text
    assert not any("query" in keys and "," in keys for keys in re.findall(r"hashpartitioning\((query#\w+, (?!\d+\))[^)]*)\)", text))


def test_links_of_a_finding_are_read_once_and_pages_without_numbers_not_at_all(spark):
    text = registry.queries()["suspect_split"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(r"stacktrace\s*</a>") == 1 and text.count(r"local\s+variables\s*</a>") == 1
    assert "all_text" not in text


@pytest.mark.parametrize(("name", "dealt"), [("oom_exact", 2), ("oom_summary", 3)])
def test_threads_and_errors_are_dealt_by_report_alone(spark, name, dealt):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert re.findall(r"Exchange hashpartitioning\(([^)]*)", text) and len(re.findall(r"Exchange hashpartitioning\(report_id#\w+, \d+\)", text)) == text.count("Exchange hashpartitioning") <= dealt
    assert "Join" not in text and "threads-" not in text
