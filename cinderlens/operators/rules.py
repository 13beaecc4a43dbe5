"""Rules as a table: thousands of prefixes and some patterns, in stages, with templates.

``id, stage, priority, prefix, pattern, category, severity, enabled, template``: a rule with a prefix fits a finding whose class,
accumulator or loader begins with it, one with a pattern a finding whose text holds it. The first rule that fits counts, in
order of stage, priority and id; stored prefixes come first, then stored patterns, then the built-in prefixes (for findings
that name a class) and the built-in patterns.

Prefixes are not tried one by one: every distinct name is cut to the lengths that prefixes have, and the pieces are joined
to the table on equality, so the work is names times lengths, however many rules there are. Patterns, of which a table has
few, become one expression. A finding's best rule is the least of its names' best ones.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.functions.steps import worked_out
from cinderlens.functions.texts import about_bytes
from cinderlens.operators.classify import FLAGS, simple_name, suspect_context, suspect_names
from cinderlens.plans import artifacts as A
from cinderlens.plans.artifacts import OBJECTS_SQL, text
from cinderlens.sources.tables import load

PREFIXES, PATTERNS, BUILT_IN_PREFIXES, BUILT_IN_PATTERNS = range(4)
RULE = "id long, stage int, priority int, prefix string, pattern string, category string, severity string, enabled boolean, template string"
#: Rules of an export that stand in one text.
EXPORTED = 1000
#: Words of explanations; fixed values.
ABOUT, INSTANCES = "약 ", "개 인스턴스"
TAKES, OF_HEAP, TAKES_SOME, MAINLY, GATHERS = "가 힙의 ", ")를 점유하고 있습니다. ", "가 메모리를 점유하고 있습니다. ", "메모리는 주로 ", "에 축적되어 있습니다. "
#: Variables of templates; anything else is empty.
VARIABLES = ("instances", "class_name", "loader", "bytes", "percent", "accumulator", "accumulator_bytes", "referrer", "severity", "is_high", "is_very_high", *(f"is_{f}" for f in FLAGS))


# ---- templates


class Template:
    """A template, read once. ``{name}`` is a value, ``{name|filter}`` a formatted one, ``{#if name}..{#else}..{/if}`` a choice.
    A brace without an end stands for itself. A choice without an end is no choice, and an end or an else of none ends the
    text there."""

    def __init__(self, source: str):
        self.pieces: list[tuple[str, str, str]] = []
        at = 0
        while at < len(source):
            end = source.find("}", at + 1) if source[at] == "{" else -1
            if end < 0:
                stop = source.find("{", at + 1)
                stop = len(source) if stop < 0 else stop
                self.pieces.append(("text", source[at:stop], ""))
                at = stop
                continue
            self.pieces.append(self._tag(source[at + 1 : end]))
            at = end + 1
        self.names = tuple(dict.fromkeys(first for kind, first, _ in self.pieces if kind in ("value", "if") and first in VARIABLES))
        # of each choice with an end: where its other branch and its end are
        self.choices: dict[int, tuple[int | None, int]] = {}
        open_: list[list[int | None]] = []
        for i, (kind, _, _) in enumerate(self.pieces):
            if kind == "if":
                open_.append([i, None])
            elif kind == "else" and open_ and open_[-1][1] is None:
                open_[-1][1] = i
            elif kind == "end" and open_:
                first, other = open_.pop()
                self.choices[first] = other, i

    @staticmethod
    def _tag(inner: str) -> tuple[str, str, str]:
        if inner.startswith("#if "):
            return "if", inner[4:].strip(), ""
        if inner in ("#else", "/if"):
            return ("else" if inner == "#else" else "end"), "", ""
        name, bar, by = inner.partition("|")
        return ("value", name.strip(), by.strip()) if bar and name else ("value", inner.strip(), "")

    def of(self, values: dict) -> str:
        return "".join(self._part(0, len(self.pieces), values))

    def _part(self, at: int, end: int, values: dict) -> Iterator[str]:
        while at < end:
            kind, first, second = self.pieces[at]
            if kind == "text":
                yield first
            elif kind == "value":
                yield formatted(values.get(first) if first in VARIABLES else None, second)
            elif kind == "if" and at in self.choices:
                other, last = self.choices[at]
                if _true(values.get(first) if first in VARIABLES else None):
                    yield from self._part(at + 1, last if other is None else other, values)
                elif other is not None:
                    yield from self._part(other + 1, last, values)
                at = last
            elif kind in ("else", "end"):
                return
            at += 1


def _true(value) -> bool:
    return bool(value)


def _plain(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _rounded(value: float) -> str:
    return str(Decimal(repr(float(value))).quantize(Decimal("0.1"), ROUND_HALF_UP))


def formatted(value, by: str) -> str:
    """A value by a filter; null is empty, an unknown filter changes nothing, and what is no number counts as 0."""
    if value is None:
        return ""
    n = value if isinstance(value, (int, float)) and not isinstance(value, bool) else 0
    if by == "bytes":
        n = int(n)
        for least, unit in ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")):
            if n >= least:
                return f"{ABOUT}{_rounded(n / least)}{unit}"
        return f"{max(n, 0)}B"
    if by == "instances":
        return f"{int(n):,}{INSTANCES}" if n > 0 else ""
    if by == "number":
        return f"{int(n):,}"
    return _rounded(n) if by == "percent" else _plain(value)


@functools.lru_cache(4096)
def _read(source: str) -> Template:
    return Template(source)


def rendered(rows: DataFrame, template: str = "template", name: str = "explanation", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` (or their columns ``keep``) with the text of each row's own template over its ``VARIABLES``; a template is read
    once a task, and of the variables those that it names."""
    columns = [c for c in rows.columns if c != template] if keep is None else list(keep)
    kinds = {f.name: f for f in rows.schema}
    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in columns) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            read = [_read(t or "") for t in table[template].to_pylist()]
            values = {n: table[n].to_pylist() for n in {n for t in {id(t): t for t in read}.values() for n in t.names}}
            said = pa.array([t.of({n: values[n][i] for n in t.names}) for i, t in enumerate(read)], pa.string())
            out = table.select(columns).append_column(name, said)
            yield from out.to_batches()

    return rows.select(*dict.fromkeys([*columns, template, *VARIABLES])).mapInArrow(run, ddl)


def enriched(explanation: Column) -> Column:
    """An explanation of a rule by pattern, after what the finding says about its class, its share and where it gathers."""
    count = F.when(F.coalesce(F.col("instances"), F.lit(0)) > 0, F.concat(F.lit(" "), F.format_string("%,d", F.col("instances").cast("long")), F.lit(INSTANCES))).otherwise("")
    size = F.when(F.coalesce(F.col("bytes"), F.lit(0)) > 0, F.when(F.col("bytes") < 1024, F.concat(F.col("bytes").cast("string"), F.lit("B"))).otherwise(about_bytes(F.col("bytes"), ABOUT))).otherwise("0B")
    share = F.when(F.col("percent") > 0, F.concat(F.lit(TAKES), F.col("percent").cast("string"), F.lit("% ("), size, F.lit(OF_HEAP))).otherwise(TAKES_SOME)
    own = F.when(F.col("class_name").isNotNull(), F.concat(simple_name(F.col("class_name")), count, share)).otherwise("")
    place = F.when(F.col("accumulator").isNotNull(), F.concat(F.lit(MAINLY), simple_name(F.col("accumulator")), F.lit(GATHERS))).otherwise("")
    return F.when(F.col("class_name").isNull() & (F.col("percent") <= 0), explanation).otherwise(F.concat(own, place, explanation))


# ---- matching


#: Rules in code: by stage and id, the condition over a finding's context.
Tests = dict[tuple[int, int], Callable[[], Column]]


def _bad_patterns(rules: DataFrame, tests: Tests) -> list[tuple[int, int]]:
    """Stages and ids of rules whose pattern is no pattern; only rules with patterns are looked at, of which a table has
    few. A rule in code needs none."""
    compiled = rules.sparkSession.sparkContext._jvm.java.util.regex.Pattern

    def bad(pattern: str) -> bool:
        try:
            compiled.compile(pattern)
        except Exception:
            return True
        return False

    rows = rules.where("enabled AND prefix IS NULL").select("stage", "id", "pattern").collect()
    return [(r["stage"], r["id"]) for r in rows if (r["stage"], r["id"]) not in tests and (r["pattern"] is None or bad(r["pattern"]))]


def active(rules: DataFrame, tests: Tests | None = None) -> DataFrame:
    """The rules that count, with their ``place`` in the stage: enabled ones, without empty prefixes and broken patterns."""
    rows = rules.where("enabled AND coalesce(prefix, 'x') <> ''")
    for stage, id_ in _bad_patterns(rules, tests or {}):
        rows = rows.where(~((F.col("stage") == stage) & (F.col("id") == id_)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("stage").orderBy("priority", "id")))


def matched(context: DataFrame, rules: DataFrame, tests: Tests | None = None, names: DataFrame | None = None) -> DataFrame:
    """``context`` (of ``suspect_context``) with the first rule that fits: ``rule, stage, category, hint, template``. ``names``
    are those of the context (of ``suspect_names``), if they are worked out by themselves."""
    tests = tests or {}
    rules = active(rules, tests).drop("place")
    # the first three tell rules apart; what a rule says goes with it, so that findings need not meet it again
    hint = F.when(F.col("severity") != "", F.col("severity")).alias("hint")
    order = F.struct("stage", "priority", F.col("id").alias("rule"), "category", hint, "template")
    prefixes = rules.where("prefix IS NOT NULL").select("prefix", order.alias("o"))
    # as many numbers as prefixes have lengths
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    named = (context if names is None else names).select("id", F.explode(F.array_distinct(F.array_compact(F.array("class_name", "accumulator", "loader")))).alias("name"), F.col("class_name").isNotNull().alias("classed"))
    pieces = named.select("name").distinct().select("name", F.explode(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where("n <= length(name)")
    # per name the best rule of all and the best one that asks for no class
    found = pieces.withColumn("prefix", F.expr("substring(name, 1, n)")).join(prefixes, "prefix").groupBy("name").agg(F.min("o").alias("any"), F.min(F.when(F.col("o.stage") < BUILT_IN_PREFIXES, F.col("o"))).alias("stored"))
    best = named.join(found.hint("merge"), "name").groupBy("id").agg(F.min(F.when(F.col("classed"), F.col("any")).otherwise(F.col("stored"))).alias("by_prefix"))
    fits = lambda r: tests[r["stage"], r["id"]]() if (r["stage"], r["id"]) in tests else F.col("text").rlike(r["pattern"])
    kind = prefixes.schema["o"].dataType
    said = lambda r: F.struct(*(F.lit(r["id" if f.name == "rule" else f.name]).cast(f.dataType).alias(f.name) for f in kind))
    few = rules.where("prefix IS NULL").withColumn("hint", hint).collect()
    chain = [F.when(fits(r), said(r)) for r in sorted(few, key=lambda r: (r["stage"], r["priority"], r["id"]))]
    by_pattern = F.coalesce(*chain) if chain else F.lit(None).cast(kind)
    rows = worked_out(context.join(best.hint("merge"), "id", "left"), by_pattern=F.when(F.col("by_prefix.stage") == PREFIXES, None).otherwise(by_pattern))
    rows = worked_out(rows, hit=F.least("by_prefix", "by_pattern")).drop("by_prefix", "by_pattern").where("hit IS NOT NULL")
    return rows.select("hit.rule", "hit.stage", *(c for c in rows.columns if c != "hit"), "hit.category", "hit.hint", "hit.template")


def ruled(findings: DataFrame, rules: DataFrame, tests: Tests | None = None) -> DataFrame:
    """The context of findings (``id, text``) that a rule fits, with the rule."""
    return matched(suspect_context(findings), rules, tests, suspect_names(findings))


#: What an explanation is completed from, and what tells the finding and its rule.
ADVISED = ("id", "rule", "stage", "category", "hint", "severity", "class_name", "instances", "bytes", "percent", "accumulator")


def advised(findings: DataFrame, rules: DataFrame, tests: Tests | None = None) -> DataFrame:
    """``id, rule, category, severity, explanation`` of the findings (``id, text``) that a rule fits; a rule's severity
    overrides the computed one."""
    rows = rendered(ruled(findings, rules, tests), keep=ADVISED)
    by_pattern = F.col("stage").isin(PATTERNS, BUILT_IN_PATTERNS)
    return rows.select("id", "rule", "category", F.coalesce("hint", "severity").alias("severity"), F.when(by_pattern, enriched(F.col("explanation"))).otherwise(F.col("explanation")).alias("explanation"))


def exported(rules: DataFrame, kind: str = "library", version: int = 1, size: int = EXPORTED) -> DataFrame:
    """``part, json``: texts with the version, the kind, the number of all rules and some ``size`` of the rules each."""
    total = rules.agg(F.count("*").alias("count"))
    listed = rules.groupBy(F.floor(F.col("id") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct(*rules.columns))).alias("rules"))
    # one row
    rows = listed.crossJoin(F.broadcast(total))
    return rows.select("part", F.to_json(F.struct(F.lit(version).alias("version"), F.lit(kind).alias("type"), "count", "rules")).alias("json"))


# ---- queries: rules made from parts and nations, findings from line items

BUILT_IN = ((1, BUILT_IN_PREFIXES, 10, "java.util.", None, "collection", None, "{instances|instances} of {class_name}{#if accumulator} in {accumulator}{#else} alone{/if}"), (2, BUILT_IN_PATTERNS, 10, None, "(?i)session", "web session", "high", "{percent|percent}% {unknown}"), (3, BUILT_IN_PATTERNS, 20, None, "(?s).*", "other", None, "{bytes|number} bytes"), (4, BUILT_IN_PATTERNS, 5, None, None, "half the heap", "critical", "{percent}% of the heap in {class_name}"))
#: A rule in code: findings that take half the heap by themselves.
IN_CODE: Tests = {(BUILT_IN_PATTERNS, 4): lambda: F.col("is_very_high") & F.col("accumulator").isNull()}
_TEMPLATES = ("{class_name} keeps {bytes|bytes}, {instances|instances}", "{#if is_high}much{#else}little{/if}: {percent|percent}%", "A{#if class_name}yes{#else}no")


def rule_table(spark: SparkSession, d: str) -> DataFrame:
    """A prefix for each part, some of them disabled and some without the dot that ends a name; a pattern for each nation,
    some of them broken; and what is built in."""
    p = F.col("p_partkey")
    chosen = F.get(F.array(*(F.lit(t) for t in _TEMPLATES)), p % 3)
    none = F.lit(None).cast("string")
    parts = load(spark, d, "part").select(p.alias("id"), F.lit(PREFIXES).alias("stage"), F.col("p_size").alias("priority"), F.concat(F.lit("com.part"), p.cast("string"), F.when(p % 7 == 0, "").otherwise(".")).alias("prefix"), none.alias("pattern"), F.col("p_type").alias("category"), F.when(p % 4 == 0, "critical").when(p % 4 == 1, "").alias("severity"), (p % 10 != 0).alias("enabled"), chosen.alias("template"))
    n = F.col("n_nationkey")
    nations = load(spark, d, "nation").select(n.cast("long").alias("id"), F.lit(PATTERNS).alias("stage"), n.alias("priority"), none.alias("prefix"), F.when(n % 5 == 0, "(?i)[broken").otherwise(text("app\\.n", n, "\\b")).alias("pattern"), F.col("n_name").alias("category"), none.alias("severity"), (n != 7).alias("enabled"), F.lit("{loader}").alias("template"))
    built_in = spark.createDataFrame([(i, s, o, x, y, c, h, True, t) for i, s, o, x, y, c, h, t in BUILT_IN], RULE)
    return parts.unionByName(nations).unionByName(built_in)


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """A finding per line: of a part's class, of a collection, of a session loaded by a nation's loader, or of nothing."""
    k, part, supp = F.col("part") % 4, F.col("part"), F.col("supp")
    name = F.when(k == 0, text("com.part", part, ".Cache")).when(k == 1, text("java.util.M", supp)).otherwise(text("org.web.Session", supp))
    tail = F.when(part % 2 == 0, text(" The memory is accumulated in one instance of com.part", supp, ".Map which occupies ", A.grouped(F.col("shallow")), " (5.00%) bytes.")).otherwise("")
    said = F.concat(A.grouped(part), F.lit(" instances of "), name, text(" loaded by app.n", supp % 30), F.lit(" occupy "), A.grouped(F.col("retained")), F.lit(" ("), F.format_string("%.2f", F.col("shallow") / 5.0), F.lit("%) bytes."), tail)
    return A.objects(spark, d).select((F.col("report_id") * 64 + F.col("ordinal")).alias("id"), F.when(k == 3, text("nothing of part ", part)).otherwise(said).alias("text"))


_RULES_SQL = """rules AS (SELECT p_partkey AS id, 0 AS stage, p_size AS priority, 'com.part' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' END AS prefix, NULL AS pattern, p_type AS category, CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN '' END AS severity, p_partkey % 10 <> 0 AS enabled, p_partkey % 3 AS t FROM part
 UNION ALL SELECT n_nationkey, 1, n_nationkey, NULL, CASE WHEN n_nationkey % 5 = 0 THEN '(?i)[broken' ELSE 'app\\.n' || n_nationkey || '\\b' END, n_name, NULL, n_nationkey <> 7, 3 FROM nation
 UNION ALL VALUES (1, 2, 10, 'java.util.', NULL, 'collection', NULL, true, 4), (2, 3, 10, NULL, '(?i)session', 'web session', 'high', true, 5), (3, 3, 20, NULL, '(?s).*', 'other', NULL, true, 6), (4, 3, 5, NULL, NULL, 'half the heap', 'critical', true, 7)),
 a AS (SELECT * FROM rules WHERE enabled AND coalesce(pattern, '') <> '(?i)[broken')"""
_NUM = lambda c: f"CASE WHEN {c} < 1024 THEN {c} || 'B' WHEN {c} < 1048576 THEN '{ABOUT}' || printf('%.1f', round({c} / 1024.0, 1)) || 'KB' WHEN {c} < 1073741824 THEN '{ABOUT}' || printf('%.1f', round({c} / 1048576.0, 1)) || 'MB' ELSE '{ABOUT}' || printf('%.1f', round({c} / 1073741824.0, 1)) || 'GB' END"
_ADVISED_SQL = f"""WITH {OBJECTS_SQL}, {_RULES_SQL}, f AS (SELECT report_id * 64 + ordinal AS id, part % 4 AS k, part, supp, retained, shallow, CASE part % 4 WHEN 0 THEN 'com.part' || part || '.Cache' WHEN 1 THEN 'java.util.M' || supp WHEN 2 THEN 'org.web.Session' || supp END AS class, CASE WHEN part % 4 <> 3 AND part % 2 = 0 THEN 'com.part' || supp || '.Map' END AS acc, CASE WHEN part % 4 <> 3 THEN 'app.n' || supp % 30 END AS loader, CASE WHEN part % 4 <> 3 THEN round(shallow / 5.0, 2) ELSE 0 END AS pct FROM objects),
 names AS (SELECT DISTINCT class AS name FROM f WHERE class IS NOT NULL UNION SELECT acc FROM f WHERE acc IS NOT NULL UNION SELECT loader FROM f WHERE loader IS NOT NULL),
 fits AS (SELECT name, min({{'s': stage, 'p': priority, 'i': id}}) AS o FROM names JOIN a ON prefix IS NOT NULL AND starts_with(name, prefix) GROUP BY 1),
 pats AS (SELECT loader, min({{'s': stage, 'p': priority, 'i': id}}) AS o FROM (SELECT DISTINCT loader FROM f WHERE loader IS NOT NULL) JOIN a ON stage = 1 AND loader = 'app.n' || id GROUP BY 1),
 b AS (SELECT f.*, list_sort(list_filter([x.o, y.o, z.o, p.o, CASE WHEN pct >= 50 AND acc IS NULL THEN {{'s': 3, 'p': 5, 'i': 4::BIGINT}} END, CASE WHEN k = 2 THEN {{'s': 3, 'p': 10, 'i': 2::BIGINT}} END, {{'s': 3, 'p': 20, 'i': 3::BIGINT}}], lambda v: v IS NOT NULL))[1] AS o FROM f LEFT JOIN fits x ON x.name = class LEFT JOIN fits y ON y.name = acc LEFT JOIN fits z ON z.name = f.loader LEFT JOIN pats p ON p.loader = f.loader),
 h AS (SELECT b.*, a.category, a.severity AS hint, a.t, a.stage, CASE WHEN pct >= 50 THEN 'critical' WHEN pct >= 25 THEN 'high' WHEN pct >= 10 THEN 'medium' WHEN pct > 0 THEN 'low' ELSE 'medium' END AS own, CASE WHEN part > 0 THEN format('{{:,}}', part) || '{INSTANCES}' ELSE '' END AS many FROM b JOIN a ON a.id = o.i AND a.stage = o.s),
 e AS (SELECT *, CASE t WHEN 0 THEN class || ' keeps ' || {_NUM("retained")} || ', ' || many WHEN 1 THEN CASE WHEN pct >= 30 THEN 'much' ELSE 'little' END || ': ' || printf('%.1f', round(pct, 1)) || '%' WHEN 2 THEN 'Ayes' WHEN 3 THEN loader WHEN 4 THEN many || ' of ' || class || CASE WHEN acc IS NULL THEN ' alone' ELSE ' in ' || acc END WHEN 5 THEN printf('%.1f', round(pct, 1)) || '% ' WHEN 7 THEN CAST(pct AS VARCHAR) || '% of the heap in ' || class ELSE coalesce(CASE WHEN k <> 3 THEN format('{{:,}}', retained) END, '') || ' bytes' END AS said FROM h)
 SELECT id, o.i AS rule, category, coalesce(nullif(hint, ''), own) AS severity, CASE WHEN stage IN (1, 3) AND class IS NOT NULL THEN split_part(class, '.', -1) || CASE WHEN many = '' THEN '' ELSE ' ' || many END || '{TAKES}' || CAST(pct AS VARCHAR) || '% (' || {_NUM("retained")} || '{OF_HEAP}' || CASE WHEN acc IS NULL THEN '' ELSE '{MAINLY}Map{GATHERS}' END || said ELSE said END AS explanation FROM e"""
QUERIES = {
    "leak_rules": (lambda s, d: ruled(_findings(s, d), rule_table(s, d), IN_CODE).select("id", "rule", "category", F.coalesce("hint", "severity").alias("severity")), f"SELECT id, rule, category, severity FROM ({_ADVISED_SQL})"),
    "rule_render": (lambda s, d: advised(_findings(s, d), rule_table(s, d), IN_CODE).select("id", "explanation"), f"SELECT id, explanation FROM ({_ADVISED_SQL})"),
    "rules_active": (lambda s, d: active(rule_table(s, d), IN_CODE).select("stage", "place", "id"), f"WITH {_RULES_SQL} SELECT stage, CAST(row_number() OVER (PARTITION BY stage ORDER BY priority, id) AS INTEGER) AS place, id FROM a"),
    "rule_export": (
        lambda s, d: exported(rule_table(s, d)).select("part", F.from_json("json", f"version int, type string, count long, rules array<struct<{', '.join(x.replace(' ', ':', 1) for x in RULE.split(', '))}>>").alias("j")).select("part", "j.version", "j.type", "j.count", F.explode("j.rules").alias("r")).select("part", "version", "type", "count", "r.id", "r.stage", "r.priority", "r.prefix", "r.pattern", "r.severity", "r.enabled"),
        f"WITH {_RULES_SQL} SELECT CAST(floor(id / {EXPORTED}) AS BIGINT) AS part, 1 AS version, 'library' AS type, count(*) OVER () AS count, id, stage, priority, prefix, pattern, severity, enabled FROM rules",
    ),
}
