"""URL filters: host and path rules, and for urls that no rule fits a verdict of their host from the link graph.

Rules are a bounded list of (verdict, host and path); a rule fits its host and all subdomains if the url's path starts
with the rule's, and the longest one wins. Hosts are then seeds: trusted by the share of their pages that rules allow,
distrusted by the share that rules block. Trust follows links (personalised PageRank from the trusted seeds), distrust
follows them backwards (a host that links to blocked ones is suspect). Vertices are hosts, edges the links between
different hosts weighted by how many there are; a host without links keeps its own value. Both scores are shares, so they
do not shrink as hosts are added: trust is the part of a host's PageRank (that with every host as a seed) that comes from
trusted seeds, and distrust is the part of the PageRank personalised to the host itself that lies on blocked seeds, which
is what distrust passed on from a host to all that link to it, by the share of their links, adds up to. So each host of a
link farm is suspect, whatever the farm's size. A host's own share as a seed is the least score it gets. A host is blocked
if its distrust reaches ``threshold`` and exceeds its trust.

Pages are reduced to one row per pair of hosts before anything iterates. A host with any share of all pages or links is
combined before its shuffle; joins at such a host are split by Spark. Ranks are written after each round.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as the host
with the empty name; such pages take part neither as seeds' neighbours nor as link sources; a null page has no links;
repeated rows count as pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable, release

#: Verdict and rule of the contract's query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 0.5
#: Absolute and scheme-relative link targets; other links stay on their host.
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    chain = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        chain.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*chain) if chain else F.lit(None).cast("struct<rule: string, verdict: string>")


def judged_pages(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` by the rules alone."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)))).alias("dst"))
    found = found.withColumn("dst", _ascii_lower(F.col("dst"))).where("src <> dst AND src <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` from ``links`` (``src, dst, n``) and ``seeds`` (``host, trust, distrust`` in 0 to 1). Rounds go on
    until nothing moves by more than ``tolerance``; what moves shrinks by ``damping`` in each, so they end."""
    links = durable(links, "links")
    if not links.limit(1).count():
        return seeds.select("host", "trust", "distrust")
    out = links.groupBy(F.col("src").alias("s")).agg(F.sum("n").alias("out_n"))
    edges = durable(links.join(out, F.col("src") == F.col("s")).select("src", "dst", (F.col("n") / F.col("out_n")).alias("share")), "edges")
    hosts = seeds.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")).unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("t0"), F.lit(0.0).alias("d0")).distinct())
    hosts = hosts.groupBy("host").agg(F.max("t0").alias("t0"), F.max("d0").alias("d0"))
    # a host that nothing leaves keeps its trust and its own distrust
    leaves = out.select(F.col("s").alias("h"), F.lit(True).alias("leaves"))
    base = hosts.join(leaves, F.col("host") == F.col("h"), "left").drop("h").na.fill(False, ["leaves"])
    ranks = durable(base.select("*", F.col("t0").alias("t"), F.lit(1.0).alias("r"), F.col("d0").alias("d")), "ranks")
    old = None
    while True:
        forth = edges.join(ranks.select(F.col("host").alias("src"), "t", "r"), "src").select(F.col("dst").alias("to"), (F.col("t") * F.col("share")).alias("gt"), (F.col("r") * F.col("share")).alias("gr"), F.lit(0.0).alias("gd"))
        back = edges.join(ranks.select(F.col("host").alias("dst"), "d"), "dst").select(F.col("src").alias("to"), F.lit(0.0).alias("gt"), F.lit(0.0).alias("gr"), (F.col("d") * F.col("share")).alias("gd"))
        got = forth.unionByName(back).groupBy("to").agg(F.sum("gt").alias("gt"), F.sum("gr").alias("gr"), F.sum("gd").alias("gd"))
        step = ranks.join(got, F.col("host") == F.col("to"), "left").drop("to").na.fill(0.0, ["gt", "gr", "gd"])
        kept = lambda c: F.when(F.col("leaves"), F.lit(0.0)).otherwise(F.col(c))
        new = {"t": (1 - damping) * F.col("t0") + damping * (F.col("gt") + kept("t")), "r": F.lit(1 - damping) + damping * (F.col("gr") + kept("r")), "d": (1 - damping) * F.col("d0") + damping * (F.col("gd") + kept("d"))}
        moved = F.greatest(*(F.abs(v - F.col(c)) / F.greatest(F.col("r"), F.lit(1.0)) for c, v in new.items()))
        step = durable(step.select("host", "t0", "d0", "leaves", *(v.alias(c) for c, v in new.items()), moved.alias("moved")), "ranks")
        if old is not None:
            release(old)
        old, ranks = step, step.drop("moved")
        if step.agg(F.max("moved")).first()[0] <= tolerance:
            break
    return ranks.select("host", F.greatest("t0", F.col("t") / F.col("r")).alias("trust"), F.greatest("d0", "d").alias("distrust"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    rows = durable(judged_pages(pages, rules, id_col, url_col), "judged")
    share = lambda v: F.count_if(F.col("verdict") == v) / F.count("*")
    seeds = durable(rows.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    scores = propagate(host_links(pages, url_col, html_col), seeds).withColumnRenamed("host", "of")
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return rows.join(scores, F.col("host") == F.col("of"), "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "trust", "distrust")
