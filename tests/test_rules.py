"""Rules as a table: first match against a loop over all rules, templates, and what is left out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cinderlens.operators import classify, rules
from cinderlens.operators.classify import suspect_context

VALUES = {"class_name": "a.b.C", "instances": 1200, "bytes": 2048, "percent": 24.25, "accumulator": None, "is_high": True, "is_map": False, "referrer": ""}


@pytest.mark.parametrize(
    ("source", "said"),
    [
        ("", ""),
        ("plain } text {open", "plain } text {open"),
        ("{class_name}/{ class_name }/{nothing}/{accumulator}/{percent}", "a.b.C/a.b.C///24.25"),
        ("{bytes|bytes} {instances|instances} {instances|number} {percent|percent} {bytes|odd}", "약 2.0KB 1,200개 인스턴스 1,200 24.3 2048"),
        ("{accumulator|bytes}|{class_name|number}|{|x}", "|0|"),
        ("{#if is_high}yes{#else}no{/if}{#if is_map}yes{#else}no{/if}{#if accumulator}x{/if}{#if referrer}x{/if}.", "yesno."),
        ("A{#if is_high}yes{#else}no", "Ayes"),
        ("A{#if is_map}yes{#else}no", "Ayes"),
        ("A{#if is_high}yes", "Ayes"),
        ("A{/if}B", "A"),
        ("A{#else}B", "A"),
        ("{#if is_high}a{#if is_map}b{#else}c{/if}d{/if}e", "acde"),
        ("{#if is_high}a{#else}b{#else}c{/if}d", "ad"),
        ("{#if is_map}a{#else}b{#else}c{/if}d", "bd"),
        ("{#if is_high}a{#if is_map}b{/if}c", "ac"),
    ],
)
def test_templates(source, said):
    assert rules.Template(source).of(VALUES) == said


@pytest.mark.parametrize(("n", "by", "said"), [(0, "bytes", "0B"), (-3, "bytes", "0B"), (1023, "bytes", "1023B"), (1 << 20, "bytes", "약 1.0MB"), (5 << 30, "bytes", "약 5.0GB"), (0, "instances", ""), (1, "instances", "1개 인스턴스"), (0.25, "percent", "0.3"), (True, "", "true"), (None, "number", "")])
def test_filters(n, by, said):
    assert rules.formatted(n, by) == said


def test_first_match_against_a_loop_over_thousands_of_rules(spark):
    rng = random.Random(6)
    names = [".".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    table = [(i, rng.choice([0, 0, 2]), rng.randrange(50), rng.choice(names)[: rng.randrange(0, 9)], None, f"c{i}", rng.choice([None, "", "low"]), rng.random() < 0.8, "") for i in range(3000)]
    table += [(i, rng.choice([1, 3]), rng.randrange(50), None, rng.choice(["instance", "b{2}", "(?i)NOTHING", "[broken", None]), f"p{i}", None, rng.random() < 0.8, "") for i in range(12)]
    texts = []
    for i in range(400):
        said = f"{i} instances of {rng.choice(names)} loaded by {rng.choice(names)} occupy 9 (12.00%) bytes."
        if i % 3 == 0:
            said += f" The memory is accumulated in one instance of {rng.choice(names)} which occupies 5 (1.00%) bytes."
        texts.append((i, said if i % 7 else f"nothing {rng.choice(['at all', 'bb'])}"))
    context = suspect_context(spark.createDataFrame(texts, "id int, text string")).cache()
    got = {r["id"]: (r["stage"], r["rule"]) for r in rules.matched(context, spark.createDataFrame(table, rules.RULE)).collect()}

    def fits(rule, c):
        _, stage, _, prefix, pattern, *_, enabled, _ = rule
        if not enabled or prefix == "" or (prefix is None and pattern in (None, "[broken")):
            return False
        if prefix is None:
            return re.search(pattern, c["text"]) is not None
        own = [c["class_name"], c["accumulator"], c["loader"]]
        return (stage < rules.BUILT_IN_PREFIXES or own[0] is not None) and any(x is not None and x.startswith(prefix) for x in own)

    expected = {}
    for c in context.collect():
        hits = sorted((r[1], r[2], r[0]) for r in table if fits(r, c))
        if hits:
            expected[c["id"]] = (hits[0][0], hits[0][2])
    assert got == expected and len({v for v in got.values()}) > 9


def test_rules_in_code_and_severities(spark):
    table = [(1, 3, 9, None, None, "code", "critical", True, "{percent|percent}"), (2, 3, 10, None, ".*", "rest", "", True, "x"), (3, 3, 1, None, None, "neither", None, True, "")]
    texts = [(1, "9 instances of a.B loaded by l occupy 9 (60.00%) bytes."), (2, "9 instances of a.B loaded by l occupy 1,536 (12.50%) bytes.")]
    tests = {(3, 1): lambda: F.col("is_very_high")}
    got = {r["id"]: tuple(r)[1:] for r in rules.advised(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(table, rules.RULE), tests).collect()}
    assert got == {1: (1, "code", "critical", "B 9개 인스턴스가 힙의 60.0% (9B)를 점유하고 있습니다. 60.0"), 2: (2, "rest", "medium", "B 9개 인스턴스가 힙의 12.5% (약 1.5KB)를 점유하고 있습니다. x")}


def test_no_rules(spark):
    texts = spark.createDataFrame([(1, "9 instances of a.B loaded by l occupy 9 (60.00%) bytes.")], "id int, text string")
    assert rules.advised(texts, spark.createDataFrame([], rules.RULE)).count() == 0


def test_findings_do_not_meet_rules_again_and_names_are_read_alone(spark):
    plan = lambda name: rules.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rule" not in plan("rule_render") and "hashpartitioning(rule" not in plan("leak_rules")
    # what no column shows is not rendered
    assert "MapInArrow" in plan("rule_render") and "MapInArrow" not in plan("leak_rules")
    texts = ["ONE Instance of a.B LOADED BY  x.L @ 0x1f occupies 1,024 (60.50%) bytes. ACCUMULATED IN one\ninstance of c.D which occupies 9 (1.0%)", "2 instances of [e.F] loaded by K occup", "instances", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    read = classify.suspect_context(rows).select("id", *classify.FINDING_NAMES)
    assert sorted(classify.suspect_names(rows).collect()) == sorted(read.collect())
    got = {r["id"]: r for r in classify.suspect_context(rows).collect()}
    assert (got[0]["class_name"], got[0]["accumulator"], got[0]["loader"], got[0]["instances"], got[0]["accumulator_bytes"], got[0]["percent"]) == ("a.B", "c.D", "x.L", 1, 9, 60.5)
    assert (got[1]["class_name"], got[1]["loader"]) == ("[e.F]", "K") and got[4]["class_name"] is None and got[4]["severity"] == "medium"


def test_only_named_variables_are_read():
    assert rules.Template("{#if is_high}{bytes|bytes}{#else}{unknown}{class_name}{/if}").names == ("is_high", "bytes", "class_name")
