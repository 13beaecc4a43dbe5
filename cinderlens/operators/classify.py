"""Classifiers: memory errors and which of them were thrown, what findings say, rule imports, and the middleware that a dump
comes from."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.functions.steps import worked_out
from cinderlens.operators.extract import thread_blocks
from cinderlens.operators.reports import _oom_page, oom_instances
from cinderlens.plans import artifacts as A
from cinderlens.plans.artifacts import INSTANCES_AT, OBJECTS_SQL, THREAD_SQL, text
from cinderlens.plans.views import severity
from cinderlens.sources.stored import new_folder, stored
from cinderlens.sources.tables import load

#: Parts of error messages and the kinds they stand for, in the order in which they are tried; fixed values.
OOM_KEYWORDS = (
    ("gc overhead", "GC_OVERHEAD"),
    ("compressed class", "COMPRESSED_CLASS_SPACE"),
    ("metaspace", "METASPACE"),
    ("permgen", "PERMGEN"),
    ("direct buffer", "DIRECT_BUFFER"),
    ("native thread", "NATIVE_THREAD"),
    ("array size", "ARRAY_SIZE"),
    ("swap space", "OUT_OF_SWAP"),
    ("kill process", "KILL_PROCESS"),
    ("native memory", "NATIVE_MEMORY"),
    ("mmap", "NATIVE_MEMORY"),
    ("heap space", "HEAP_SPACE"),
)
#: Frames that stand near the throw of some kinds, in the order in which they are tried; fixed values.
OOM_FRAMES = (
    ("NATIVE_THREAD", ("java.lang.Thread.start0", "java.lang.Thread.start(", "java.util.concurrent.ThreadPoolExecutor.addWorker")),
    ("DIRECT_BUFFER", ("java.nio.Bits.reserve", "java.nio.DirectByteBuffer.<init>", "sun.nio.ch.Util.getTemporaryDirectBuffer")),
    ("METASPACE", ("java.lang.ClassLoader.defineClass", "ClassLoader.defineClass1", "ClassLoader.defineClass2", "java.lang.reflect.Proxy", "sun.instrument.", "jdk.internal.reflect.")),
)
#: Messages of the kinds that frames tell; fixed values.
OOM_MESSAGES = {"NATIVE_THREAD": "unable to create new native thread", "DIRECT_BUFFER": "Direct buffer memory", "METASPACE": "Metaspace", "HEAP_SPACE": "Java heap space"}
INFERRED = " (inferred)"
OOM_CLASS = "java.lang.OutOfMemoryError"
#: An error in a stack and its message, if it has one; the first one counts; fixed value.
OOM_ERROR = r"java\.lang\.OutOfMemoryError(?::\s*([^\r\n]+))?"


@dataclass(frozen=True)
class Vendor:
    """A middleware: starts of its class names, properties that prove it, properties that hold its version, and the word
    before its version in paths."""

    name: str
    prefixes: tuple[str, ...]
    markers: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    token: str | None = None


#: In the order that settles equal scores; fixed values.
VENDORS = (
    Vendor("Oracle WebLogic", ("weblogic.",), ("weblogic.Name", "weblogic.home", "weblogic.RootDirectory"), ("weblogic.version",), "wlserver"),
    Vendor("TmaxSoft JEUS", ("jeus.",), ("jeus.home", "jeus.server.name", "jeus.baseport"), ("jeus.version",), "jeus"),
    Vendor("Apache Tomcat", ("org.apache.catalina.", "org.apache.coyote.", "org.apache.tomcat."), ("catalina.home", "catalina.base"), ("catalina.version", "tomcat.version"), "tomcat"),
    Vendor("IBM WebSphere", ("com.ibm.ws.", "com.ibm.websphere."), ("was.install.root", "server.root", "ws.ext.dirs"), ("com.ibm.websphere.productVersion",), "websphere"),
    Vendor("Eclipse Jetty", ("org.eclipse.jetty.",), ("jetty.home", "jetty.base"), ("jetty.version",), "jetty"),
    Vendor("JBoss/WildFly", ("org.jboss.as.", "org.wildfly.", "org.jboss.web.", "org.jboss.servlet."), ("jboss.home.dir", "jboss.server.name", "jboss.server.base.dir"), ("jboss.home.version",), "wildfly"),
    Vendor("Undertow", ("io.undertow.",)),
    Vendor("Caucho Resin", ("com.caucho.",), ("resin.home",), ("resin.version",), "resin"),
)
#: Least score of a vendor, and what a property that proves one adds; fixed values.
LEAST_SCORE, MARKER_SCORE = 3, 100
#: A version in a class's name; fixed value.
VERSION_IN_NAME = r"[._]v?(\d{1,2}(?:[._]\d{1,3}){1,3})(?:[._]|$|[A-Za-z])"


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def oom_columns(stack: Column) -> dict[str, Column]:
    """Whether a stack holds a memory error, its kind, what to show for it, and whether that is inferred from frames."""
    message = F.trim(F.regexp_extract(stack, OOM_ERROR, 1))
    by_message = F.coalesce(*(F.when(F.lower(message).contains(k), F.lit(v)) for k, v in OOM_KEYWORDS), F.lit("UNKNOWN"))
    by_frame = F.coalesce(*(F.when(_any(stack, parts), F.lit(kind)) for kind, parts in OOM_FRAMES), F.lit("HEAP_SPACE"))
    oom = F.coalesce(stack.contains(OOM_CLASS), F.lit(False))
    said = message != ""
    shown = F.create_map(*(F.lit(x) for pair in OOM_MESSAGES.items() for x in pair))[by_frame]
    return {"oom": oom, "kind": F.when(oom, F.when(said, by_message).otherwise(by_frame)), "type": F.when(oom, F.when(said, message).otherwise(F.concat(shown, F.lit(INFERRED)))), "inferred": oom & ~said}


def oom_kind(rows: DataFrame) -> DataFrame:
    return rows.select("report_id", "address", *(c.alias(name) for name, c in oom_columns(F.col("stack")).items()))


def oom_exact(dump: DataFrame, instances: DataFrame) -> DataFrame:
    """Threads with a memory error by what was thrown. The errors that the virtual machine keeps ready are in every heap;
    those that a thread's locals refer to were thrown. The most frequent message of these in a report (of equally frequent
    ones that which stands first on the page) stands for the threads whose stacks show an error; a thread that only stands
    in a call that can fail so gets the message of an error among its own locals. ``instances``: ``report_id, address,
    message, pos``, an address once a report."""
    blocks = thread_blocks(dump)
    c = oom_columns(F.col("stack"))
    prone = _any(F.col("stack"), OOM_FRAMES[0][1]) | _any(F.col("stack"), OOM_FRAMES[1][1])
    ids = F.array_distinct(F.regexp_extract_all(F.lower("block"), F.lit("objectid=0x([0-9a-f]+)"), F.lit(1)))
    threads = blocks.select("report_id", "address", c["oom"].alias("seen"), c["type"].alias("inferred"), prone.alias("prone"), F.posexplode_outer(ids).alias("nth", "hex")).withColumn("object_id", F.conv("hex", 16, 10)).drop("hex")
    known = instances.where("message IS NOT NULL").select("report_id", F.col("address").alias("object_id"), "message", "pos")
    # both sides are dealt by report, and so is all that follows: dumps and pages are read once, and their rows are put
    # beside each other where a join by more than the report would move them
    rows = threads.unionByName(known, allowMissingColumns=True)
    within = lambda *keys: Window.partitionBy("report_id", *keys)
    rows = rows.withColumn("thrown", F.col("message").isNotNull() & (F.count("address").over(within("object_id")) > 0)).withColumn("message", F.when(F.col("object_id").isNotNull(), F.max("message").over(within("object_id")))).where("address IS NOT NULL OR thrown")
    rows = rows.withColumn("n", F.count_if("thrown").over(within("message"))).withColumn("first", F.min(F.when(F.col("thrown"), F.col("pos"))).over(within("message")))
    rows = rows.withColumn("exact", F.max_by("message", F.when(F.col("thrown"), F.struct("n", -F.col("first")))).over(within()))
    own = F.min_by("message", F.when(F.col("message").isNotNull(), F.col("object_id").cast("decimal(20,0)")))
    rows = rows.where("address IS NOT NULL").withColumn("own", own.over(within("address"))).where("coalesce(nth, 0) = 0")
    kind = F.when(F.col("seen"), F.coalesce("exact", "inferred")).when(F.col("prone"), F.col("own"))
    return rows.withColumn("type", kind).where("type IS NOT NULL").select("report_id", "address", "seen", "type")


def oom_summary(threads: DataFrame, shown: int = 5) -> DataFrame:
    """How many threads of a report have an error, the first one's type, the first five names and how many are left."""
    w = Window.partitionBy("report_id").orderBy("address")
    rows = threads.withColumn("nth", F.row_number().over(w))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "name")))), lambda x: x["name"]), ",")
    return rows.groupBy("report_id").agg(F.count("*").alias("threads"), F.min_by("type", "nth").alias("first_type"), names.alias("names"), F.greatest(F.count("*") - shown, F.lit(0)).alias("left"))


# ---- findings and rules

_NUMBER = r"([\d,]+)\s+\(([\d.]+)%\)"
#: Where a finding's sentence holds its parts; fixed values.
FINDING = {
    "instances": (r"(?i)(\d[\d,]*|One|one)\s+instances?\s+of\s+([\w.$\[\]<>]+)", 1),
    "class_name": (r"(?i)(\d[\d,]*|One|one)\s+instances?\s+of\s+([\w.$\[\]<>]+)", 2),
    "loader": (r"(?i)loaded by\s+(.*?)(?:\s*@\s*0x[\da-fA-F]+)?\s+occup", 1),
    "bytes": (r"(?i)occup(?:y|ies)\s+([\d,]+)\s+\(([\d.]+)%\)\s+bytes", 1),
    "percent": (r"(?i)occup(?:y|ies)\s+([\d,]+)\s+\(([\d.]+)%\)\s+bytes", 2),
    "accumulator": (rf"(?is)accumulated in.*?instance of\s+([\w.$]+).*?occup(?:y|ies)\s+{_NUMBER}", 1),
    "accumulator_bytes": (rf"(?is)accumulated in.*?instance of\s+([\w.$]+).*?occup(?:y|ies)\s+{_NUMBER}", 2),
    "referrer": (r"(?i)referenced from.*?instance of\s+([\w.$\[\]]+)", 1),
}
#: Words without which a part is not looked for; fixed values.
FINDING_WORDS = {"instances": "instance", "class_name": "instance", "loader": "loaded by", "bytes": "occup", "percent": "occup", "accumulator": "accumulated in", "accumulator_bytes": "accumulated in", "referrer": "referenced from"}
FINDING_NAMES = ("class_name", "accumulator", "loader")
#: Parts of simple class names and the flags they set; fixed values.
FLAGS = {"stream": ("inputstream", "outputstream", "reader", "writer"), "session": ("session",), "thread": ("thread",), "class_loader": ("classloader",), "cache": ("cache",), "map": ("map", "hashtable", "dictionary")}


def simple_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def _found(rows: DataFrame, parts) -> DataFrame:
    rows = worked_out(rows, low=F.lower("text"))
    return worked_out(rows, **{f"found_{k}": F.when(F.col("low").contains(FINDING_WORDS[k]), F.regexp_extract("text", *FINDING[k])).otherwise("") for k in parts})


def suspect_names(rows: DataFrame) -> DataFrame:
    """``id, class_name, accumulator, loader`` of findings, as in their context."""
    name = lambda k: F.trim(f"found_{k}") if k == "loader" else F.col(f"found_{k}")
    return _found(rows, FINDING_NAMES).select("id", *(F.nullif(name(k), F.lit("")).alias(k) for k in FINDING_NAMES))


def suspect_context(rows: DataFrame) -> DataFrame:
    """What a finding's sentence says: count, class, loader, sizes, percent, accumulator, referrer, severity, and flags."""
    rows = _found(rows, FINDING)
    part = lambda k: F.col(f"found_{k}")
    filled = lambda c: F.when(c != "", c)
    number = lambda k: F.replace(part(k), F.lit(","), F.lit("")).try_cast("long")
    rows = worked_out(rows, simple=F.coalesce(F.lower(simple_name(filled(part("class_name")))), F.lit("")), share=F.coalesce(part("percent").try_cast("double"), F.lit(0.0)))
    percent = F.col("share")
    return rows.select(
        "id",
        "text",
        F.when(F.lower(part("instances")) == "one", F.lit(1)).otherwise(number("instances")).alias("instances"),
        filled(part("class_name")).alias("class_name"),
        filled(F.trim(part("loader"))).alias("loader"),
        number("bytes").alias("bytes"),
        percent.alias("percent"),
        filled(part("accumulator")).alias("accumulator"),
        number("accumulator_bytes").alias("accumulator_bytes"),
        filled(simple_name(part("referrer"))).alias("referrer"),
        severity(percent).alias("severity"),
        (percent >= 30).alias("is_high"),
        (percent >= 50).alias("is_very_high"),
        *(_any(F.col("simple"), parts).alias(f"is_{flag}") for flag, parts in FLAGS.items()),
    )


def rule_import(file: DataFrame, existing: DataFrame, mode: str = "append", repeated: str = "overwrite") -> DataFrame:
    """What an import does with each rule: ``key, id, action, value``. ``file``: ``key, pos, value``; ``existing``: ``key,
    id``. ``replace`` deletes all and inserts; ``append`` inserts all, or with ``skip`` or ``overwrite`` takes the last one
    of a key in the file and skips or updates the first existing one."""
    if mode == "replace":
        gone = existing.select("key", "id", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("value"))
        return gone.unionByName(file.select("key", F.lit(None).cast("long").alias("id"), F.lit("insert").alias("action"), "value"))
    if repeated not in ("skip", "overwrite"):
        return file.select("key", F.lit(None).cast("long").alias("id"), F.lit("insert").alias("action"), "value")
    last = file.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    first = existing.groupBy("key").agg(F.min("id").alias("id"))
    return last.join(first, "key", "left").select("key", "id", F.when(F.col("id").isNull(), "insert").otherwise("skip" if repeated == "skip" else "update").alias("action"), "value")


# ---- middleware


def middleware(stacks: DataFrame, names: DataFrame, properties: DataFrame) -> DataFrame:
    """The vendor with the highest score of each report and its version. ``stacks``: ``report_id, stack``, in which each
    place of a prefix counts; ``names``: ``report_id, name``, whose start counts; ``properties``: ``report_id, key, value``,
    where a marker counts a hundred. Scores below three do not count, and equal ones go to the first vendor."""
    occurrences = lambda c, p: F.regexp_count(c, F.lit(re.escape(p)))
    zero = F.lit(0).cast("long")
    in_stack = [sum((F.sum(occurrences("stack", p)) for p in v.prefixes), zero).alias(f"s{i}") for i, v in enumerate(VENDORS)]
    starts = lambda v: F.sum(F.when(_starts(F.trim("name"), v.prefixes), 1).otherwise(0))
    in_names = [starts(v).alias(f"n{i}") for i, v in enumerate(VENDORS)]
    held = [(F.count_if(F.col("key").isin(*v.markers) & (F.trim("value") != "")) * MARKER_SCORE if v.markers else zero).alias(f"p{i}") for i, v in enumerate(VENDORS)]
    scores = stacks.groupBy("report_id").agg(*in_stack).join(names.groupBy("report_id").agg(*in_names), "report_id", "full").join(properties.groupBy("report_id").agg(*held), "report_id", "full")
    total = lambda i: sum((F.coalesce(F.col(f"{k}{i}"), zero) for k in "snp"), zero)
    best = F.array_max(F.array(*(F.struct(total(i).alias("score"), F.lit(-i).alias("place")) for i in range(len(VENDORS)))))
    scores = scores.select("report_id", best.alias("b")).where(F.col("b.score") >= LEAST_SCORE).select("report_id", "b.score", (-F.col("b.place")).alias("v"))
    # versions by property, then by the word before a version in any value, by each vendor that has them
    number = r"[^0-9]{0,12}(\d{1,2}(?:\.\d{1,3}){1,3})"
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    stated, found = [], []
    for i, v in enumerate(VENDORS):
        keyed = [F.max(F.when(F.col("key") == k, filled("value"))) for k in v.versions]
        stated.append((F.coalesce(*keyed) if keyed else F.lit(None).cast("string")).alias(f"stated{i}"))
        hit = F.regexp_extract("value", f"(?i){v.token}{number}", 1) if v.token else F.lit("")
        found.append(F.min_by(hit, F.when(hit != "", F.col("key"))).alias(f"found{i}"))
    versions = properties.groupBy("report_id").agg(*stated, *found)
    # last by a version in the name of one of the vendor's classes
    in_name = F.replace(F.regexp_extract(F.trim("name"), VERSION_IN_NAME, 1), F.lit("_"), F.lit("."))
    of_vendor = lambda v: F.min(F.when(_starts(F.trim("name"), v.prefixes) & (in_name != ""), F.struct(F.col("name"), in_name.alias("version"))))["version"]
    classes = names.groupBy("report_id").agg(*(of_vendor(v).alias(f"named{i}") for i, v in enumerate(VENDORS)))
    version = F.coalesce(*(F.when(F.col("v") == i, F.coalesce(f"stated{i}", f"found{i}", f"named{i}")) for i in range(len(VENDORS))))
    named = F.element_at(F.array(*(F.lit(v.name) for v in VENDORS)), F.col("v") + 1)
    return scores.join(versions, "report_id", "left").join(classes, "report_id", "left").select("report_id", named.alias("vendor"), "score", version.alias("version"))


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


# ---- queries


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """A finding per line, in five forms."""
    k, s = F.col("part") % 5, F.col("supp")
    n = F.when(F.col("part") % 7 == 0, F.lit("One")).otherwise(A.grouped(F.col("part")))
    name = F.when(k == 0, text("com.acme.Cache", s)).when(k == 1, text("java.util.HashMap")).when(k == 2, text("org.web.Session", s)).otherwise(text("app.Reader", s))
    loaded = F.when(k == 3, F.lit("com.acme.Loader @ 0xab")).otherwise(F.lit("app"))
    tail = F.when(F.col("part") % 2 == 0, text(" The memory is accumulated in one instance of java.util.Map", s, " which occupies ", A.grouped(F.col("shallow")), " (5.00%) bytes.")).otherwise(F.lit(" It is referenced from one instance of app.x.Holder now."))
    said = F.concat(n, F.lit(" instances of "), name, F.lit(" loaded by "), loaded, F.lit(" occupy "), A.grouped(F.col("retained")), F.lit(" ("), F.format_string("%.2f", F.col("shallow") / 5.0), F.lit("%) bytes."), tail)
    return A.objects(spark, d).select((F.col("report_id") * 64 + F.col("ordinal")).alias("id"), F.when(k == 4, text("nothing of part ", F.col("part"))).otherwise(said).alias("text"))


_CTX = f"""c AS (SELECT report_id * 64 + ordinal AS id, part % 5 AS k, part, supp, retained, part % 5 <> 4 AS said, CASE WHEN part % 7 = 0 THEN 1 ELSE part END AS n, shallow, round(shallow / 5.0, 2) AS pct FROM {{objects}}),
 x AS (SELECT id, k, CASE WHEN said THEN n END AS instances, CASE WHEN k = 0 THEN 'com.acme.Cache' || supp WHEN k = 1 THEN 'java.util.HashMap' WHEN k = 2 THEN 'org.web.Session' || supp WHEN k = 3 THEN 'app.Reader' || supp END AS class_name, CASE WHEN k = 3 THEN 'com.acme.Loader' WHEN said THEN 'app' END AS loader, CASE WHEN said THEN retained END AS bytes, CASE WHEN said THEN pct ELSE 0 END AS percent,
 CASE WHEN said AND part % 2 = 0 THEN 'java.util.Map' || supp END AS accumulator, CASE WHEN said AND part % 2 = 0 THEN shallow END AS accumulator_bytes, CASE WHEN said AND part % 2 = 1 THEN 'Holder' END AS referrer FROM c),
 s AS (SELECT *, CASE WHEN percent >= 50 THEN 'critical' WHEN percent >= 25 THEN 'high' WHEN percent >= 10 THEN 'medium' WHEN percent > 0 THEN 'low' ELSE 'medium' END AS severity FROM x)""".replace("{objects}", "objects")


def _error_threads(spark: SparkSession, d: str) -> DataFrame:
    names = A.objects(spark, d).select("report_id", A.thread_address().alias("address"), text("worker-", F.col("supp")).alias("name"))
    # put beside each other: both are dealt by report
    rows = oom_exact(A.thread_dump(spark, d), oom_instances(_oom_page(spark, d))).unionByName(names, allowMissingColumns=True)
    return rows.groupBy("report_id", "address").agg(*(F.max(x).alias(x) for x in ("seen", "type", "name"))).where("type IS NOT NULL AND name IS NOT NULL")


def _rule_file(spark: SparkSession, d: str) -> DataFrame:
    """A rule per line of an order's first part number, so that keys repeat."""
    return load(spark, d, "orders").select(text("com.k", F.col("o_custkey"), ".").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))


def _rule_table(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").where("c_acctbal > 0").select(text("com.k", F.col("c_custkey"), ".").alias("key"), F.col("c_custkey").alias("id"))


def _middleware(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reports: frames and names by part, properties by order."""
    lines = A.objects(spark, d)
    k = F.col("part") % 6
    stacks = lines.select("report_id", F.when(k == 0, "at org.apache.catalina.core.X\n at org.apache.coyote.Y").when(k == 1, "at weblogic.work.Z").otherwise("at app.M").alias("stack"))
    names = lines.select("report_id", F.when(F.col("part") % 12 == 2, "io.undertow.v2_3_1.B").when(k == 2, "io.undertow.server.A").when(k == 3, "jeus.B").otherwise("x.io.undertow.C").alias("name"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"))
    key = lambda c: F.col("report_id") % c == 0
    entries = F.array(F.struct(F.lit("sun.java.command").alias("key"), text("/opt/apache-tomcat-9.0.", F.col("report_id") % 90, "/bin").alias("value")), F.struct(F.when(key(7), "jboss.home.dir").otherwise("x").alias("key"), F.lit("/j").alias("value")), F.struct(F.when(key(11), "weblogic.version").otherwise("y").alias("key"), text(" 12.", F.col("report_id"), " ").alias("value")))
    return middleware(stacks, names, o.select("report_id", F.explode(entries).alias("e")).select("report_id", "e.key", "e.value"))


_THROWN = f"""t AS (SELECT report_id, {THREAD_SQL} AS address, part, supp, part % 8 AS k, CASE WHEN part % 3 <> 0 THEN supp END AS local FROM objects),
 i AS (SELECT report_id, supp, max_by(coalesce(CASE WHEN part % 4 <> 0 THEN 'Java heap space ' || part % 3 END, '-'), ordinal) AS message, min(ordinal) AS place FROM objects WHERE part % 9 <> 0 GROUP BY 1, 2),
 h AS (SELECT t.report_id, t.address, i.supp, message, place FROM t JOIN i ON t.report_id = i.report_id AND t.local = i.supp WHERE message <> '-'),
 n AS (SELECT report_id, message, count(*) AS n, min(place) AS first FROM (SELECT DISTINCT report_id, supp, message, place FROM h) GROUP BY 1, 2),
 p AS (SELECT report_id, arg_min(message, (-n, first)) AS exact FROM n GROUP BY 1), w AS (SELECT report_id, address, min_by(message, supp) AS own FROM h GROUP BY 1, 2),
 e AS (SELECT t.report_id, t.address, t.supp, k IN (0, 2, 3, 5, 6) AS seen, CASE WHEN k IN (0, 2, 3, 5, 6) THEN coalesce(exact, CASE k WHEN 0 THEN 'unable to create new native thread (inferred)' WHEN 2 THEN 'GC overhead limit exceeded' WHEN 3 THEN 'Java heap space (inferred)' WHEN 5 THEN 'Metaspace (inferred)' ELSE 'something odd' END) WHEN k = 1 THEN own END AS type
 FROM t LEFT JOIN p ON t.report_id = p.report_id LEFT JOIN w ON t.report_id = w.report_id AND t.address = w.address)"""
_FLAG_SQL = "coalesce(k = 3, false) AS is_stream, coalesce(k = 2, false) AS is_session, false AS is_thread, false AS is_class_loader, coalesce(k = 0, false) AS is_cache, coalesce(k = 1, false) AS is_map"
QUERIES = {
    "oom_kind": (lambda s, d: oom_kind(thread_blocks(A.thread_dump(s, d))), f"""WITH {OBJECTS_SQL} SELECT report_id, {THREAD_SQL} AS address, part % 8 IN (0, 2, 3, 5, 6) AS oom, CASE part % 8 WHEN 0 THEN 'NATIVE_THREAD' WHEN 2 THEN 'GC_OVERHEAD' WHEN 3 THEN 'HEAP_SPACE' WHEN 5 THEN 'METASPACE' WHEN 6 THEN 'UNKNOWN' END AS kind,
 CASE part % 8 WHEN 0 THEN 'unable to create new native thread (inferred)' WHEN 2 THEN 'GC overhead limit exceeded' WHEN 3 THEN 'Java heap space (inferred)' WHEN 5 THEN 'Metaspace (inferred)' WHEN 6 THEN 'something odd' END AS type, part % 8 IN (0, 3, 5) AS inferred FROM objects"""),
    "oom_exact": (lambda s, d: oom_exact(A.thread_dump(s, d), oom_instances(_oom_page(s, d))), f"WITH {OBJECTS_SQL}, {_THROWN} SELECT report_id, address, seen, type FROM e WHERE type IS NOT NULL"),
    "oom_summary": (lambda s, d: oom_summary(_error_threads(s, d)), f"WITH {OBJECTS_SQL}, {_THROWN}, k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY address) AS nth FROM e WHERE type IS NOT NULL) SELECT report_id, count(*) AS threads, min_by(type, nth) AS first_type, string_agg('worker-' || supp, ',' ORDER BY nth) FILTER (nth <= 5) AS names, greatest(count(*) - 5, 0) AS left FROM k GROUP BY 1"),
    "suspect_context": (lambda s, d: suspect_context(_sentences(s, d)).drop("text"), f"WITH {OBJECTS_SQL}, {_CTX} SELECT id, instances, class_name, loader, bytes, percent, accumulator, accumulator_bytes, referrer, severity, percent >= 30 AS is_high, percent >= 50 AS is_very_high, {_FLAG_SQL} FROM s"),
    "rule_import": (lambda s, d: rule_import(_rule_file(s, d), _rule_table(s, d)), "SELECT f.key, id, CASE WHEN id IS NULL THEN 'insert' ELSE 'update' END AS action, value FROM (SELECT o_custkey, 'com.k' || o_custkey || '.' AS key, max_by(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1, 2) f LEFT JOIN (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0) e ON o_custkey = id"),
    "middleware": (
        _middleware,
        f"""WITH {OBJECTS_SQL}, l AS (SELECT report_id, count(*) FILTER (part % 6 = 0) * 2 AS tomcat, count(*) FILTER (part % 6 = 1) AS weblogic, count(*) FILTER (part % 6 = 2) AS undertow, count(*) FILTER (part % 6 = 3) AS jeus, count(*) FILTER (part % 12 = 2) AS marked FROM objects GROUP BY 1),
 o AS (SELECT o_orderkey AS report_id, coalesce(weblogic, 0) AS weblogic, coalesce(jeus, 0) AS jeus, coalesce(tomcat, 0) AS tomcat, CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS wildfly, coalesce(undertow, 0) AS undertow, coalesce(marked, 0) AS marked FROM orders LEFT JOIN l ON report_id = o_orderkey),
 b AS (SELECT *, greatest(weblogic, jeus, tomcat, wildfly, undertow) AS score FROM o),
 v AS (SELECT report_id, score, CASE score WHEN weblogic THEN 'Oracle WebLogic' WHEN jeus THEN 'TmaxSoft JEUS' WHEN tomcat THEN 'Apache Tomcat' WHEN wildfly THEN 'JBoss/WildFly' ELSE 'Undertow' END AS vendor, marked FROM b WHERE score >= 3)
 SELECT report_id, vendor, score, CASE WHEN vendor = 'Apache Tomcat' THEN '9.0.' || report_id % 90 WHEN vendor = 'Oracle WebLogic' AND report_id % 11 = 0 THEN '12.' || report_id WHEN vendor = 'Undertow' AND marked > 0 THEN '2.3.1' END AS version FROM v""",
    ),
}
