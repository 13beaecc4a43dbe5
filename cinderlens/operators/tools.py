"""Text rules over whole tables, and the joins and lists around files: uploads, cores and programs, scans, chats,
comparisons, class look-ups and figures of heaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.functions import texts as T
from cinderlens.functions.scalars import format_bytes
from cinderlens.operators.diffs import histogram
from cinderlens.operators.records import matching
from cinderlens.plans import artifacts as A
from cinderlens.plans.artifacts import OBJECTS_SQL, text
from cinderlens.plans.views import HISTORY_SQL, TRANSFERS_SQL, history, transfers
from cinderlens.sources.tables import load

#: Shares of the heap, bytes an object and objects from which a component is remarked on; fixed values.
LARGE_SHARE, NOTABLE_SHARE, LARGE_OBJECT, MANY_OBJECTS = 30, 10, 1 << 20, 100_000
#: Characters of an attachment; fixed value.
ATTACHED_CHARS = 200_000
SHOWN_CLASSES = 25


def component_remarks(percent: Column, warnings: Column, size: Column, objects: Column) -> Column:
    """Remarks on a component, in order."""
    share = F.when(percent >= LARGE_SHARE, "large share").when(percent >= NOTABLE_SHARE, "notable share").when(percent > 0, "normal share")
    known = (objects > 0) & (size > 0)
    each = F.when(known & (size / objects > LARGE_OBJECT), "large objects").when(known & (objects > MANY_OBJECTS), "many objects")
    return F.array_compact(F.array(share, F.when(warnings > 0, F.concat(warnings.cast("string"), F.lit(" warnings"))), each))


def heap_usage(tops: DataFrame) -> DataFrame:
    """Used, free and percent of each report: the sum of its top objects against the total, or what the overview said."""
    out = tops.groupBy("report_id").agg(F.sum("retained").alias("top"), F.max("total_heap").alias("total"), F.max("stated").alias("stated"))
    summed = (F.col("total") > 0) & (F.col("top") > 0)
    used = F.when(summed, F.col("top")).otherwise(F.col("stated"))
    return out.select("report_id", used.alias("used"), F.when(summed, F.col("total") - F.col("top")).otherwise(F.lit(0)).alias("free"), F.when(F.col("total") > 0, used * 100.0 / F.col("total")).alias("percent"))


def heap_check(files: DataFrame, tool_heap: int) -> DataFrame:
    """The size that a dump has when unpacked, from the first source that knows it, and whether the tool's heap is less than
    twice that; its halves go to the even digit, as in C's printf. ``files``: ``id, working, plain, packed, recorded, trailer``
    in bytes, null where there is none."""
    packed = F.when(F.col("recorded") > F.col("packed"), F.col("recorded")).when(F.col("trailer") > F.col("packed"), F.col("trailer")).otherwise(F.col("packed"))
    size = F.coalesce("working", "plain", packed, F.lit(0))
    return files.select("id", size.alias("size"), ((size > 0) & (size * 2 > tool_heap) & F.lit(tool_heap > 0)).alias("warning"), format_bytes(size * 2, F.bround).alias("recommended"))


def upload_status(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Whether an upload's content is there already (same size and hash: the file with the smallest name), else its name,
    with a free name: the first of ``_2``, ``_3``, … that no file has. ``uploads``: ``id, name, size, hash``; ``files``:
    ``name, size, hash``."""
    same = files.groupBy(F.col("size").alias("fs"), F.col("hash").alias("fh")).agg(F.min("name").alias("same"))
    names = files.select(F.col("name").alias("taken")).distinct()
    rows = uploads.join(same, (F.col("size") == F.col("fs")) & (F.col("hash") == F.col("fh")), "left").join(names, F.col("name") == F.col("taken"), "left")
    # numbers that names of the same stem and extension have
    numbered = files.select(F.regexp_extract(T.strip_extension(F.col("name")), r"^(.+)_(\d+)$", 1).alias("stem"), T.extension(F.col("name")).alias("ext"), F.regexp_extract(T.strip_extension(F.col("name")), r"^(.+)_(\d+)$", 2).try_cast("long").alias("n")).where("n >= 2").distinct()
    # the first gap: n stays equal to its place in the ranks from 2 on
    runs = numbered.withColumn("place", F.row_number().over(Window.partitionBy("stem", "ext").orderBy("n")) + 1).where("n = place").groupBy("stem", "ext").agg((F.max("n") + 1).alias("free"))
    rows = rows.withColumn("stem_", T.strip_extension(F.col("name"))).withColumn("ext_", T.extension(F.col("name"))).join(runs, (F.col("stem_") == F.col("stem")) & (F.col("ext_") == F.col("ext")), "left")
    status = F.when(F.col("same").isNotNull(), "DUPLICATE_CONTENT").when(F.col("taken").isNotNull(), "DUPLICATE_NAME").otherwise("OK")
    free = F.concat("stem_", F.lit("_"), F.coalesce("free", F.lit(2)).cast("string"), F.lit("."), F.col("ext_"))
    return rows.select("id", status.alias("status"), F.when(status == "DUPLICATE_CONTENT", F.col("same")).when(status == "DUPLICATE_NAME", F.col("name")).alias("existing"), F.when(status == "DUPLICATE_NAME", free).alias("suggested"))


def core_list(files: DataFrame, analysed: DataFrame) -> DataFrame:
    """Core files with their analysis and the program beside them (``NAME.exec``); programs, hidden files and what is
    paired are no rows of their own. ``files``: ``name, size``; ``analysed``: ``name, status``."""
    programs = files.where(F.col("name").endswith(".exec")).select(F.regexp_replace("name", r"\.exec$", "").alias("of"), F.col("name").alias("program"))
    cores = files.where(~F.col("name").endswith(".exec") & ~F.col("name").startswith("."))
    rows = cores.join(programs, F.col("name") == F.col("of"), "left").join(analysed.withColumnRenamed("name", "an"), F.col("name") == F.col("an"), "left")
    return rows.select("name", "size", F.coalesce("status", F.lit("NOT_ANALYZED")).alias("status"), "program")


def core_filter(cores: DataFrame, query: str = "", status: str = "", paired: bool | None = None) -> DataFrame:
    """Of ``core_list`` the rows whose name holds the query, in any case, with this status, and with or without a program;
    what is not given is no criterion."""
    out = cores.where(F.lower("name").contains(query.strip().lower())) if query.strip() else cores
    out = out.where(F.col("status") == status) if status else out
    return out if paired is None else out.where(F.col("program").isNotNull() == F.lit(paired))


def scan_status(scanned: DataFrame, log: DataFrame, local: DataFrame, analysed: DataFrame) -> DataFrame:
    """Scanned files (the newest of each path) with the newest successful transfer of the same server, name and size whose
    copy is still there, and whether that was analysed."""
    newest = Window.partitionBy("server_id", "path").orderBy(F.desc("mtime"), "size")
    rows = scanned.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
    moved = log.where("status = 'SUCCESS'").join(local, "filename", "left_semi").groupBy("server_id", "remote", "file_size").agg(F.max_by("filename", F.struct("started_at", "id")).alias("copy"))
    rows = rows.join(moved.withColumnRenamed("server_id", "ms"), (F.col("server_id") == F.col("ms")) & (F.col("path") == F.col("remote")) & (F.col("size") == F.col("file_size")), "left")
    done = analysed.select(F.col("filename").alias("af")).distinct()
    return rows.join(done, F.col("copy") == F.col("af"), "left").select("server_id", "path", "size", "copy", F.when(F.col("af").isNotNull(), "ANALYZED").when(F.col("copy").isNotNull(), "TRANSFERRED").otherwise("NEW").alias("state"))


def chat_state(sessions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Whether a chat is about the present analysis of its file, an earlier one, one that is gone, or none.
    ``sessions``: ``id, filename, analyzed_at``; ``analyses``: ``filename, analyzed_at``."""
    exact = analyses.select(F.col("filename").alias("ef"), F.col("analyzed_at").alias("ea")).distinct()
    any_ = analyses.select(F.col("filename").alias("nf")).distinct()
    rows = sessions.join(exact, (F.col("filename") == F.col("ef")) & (F.col("analyzed_at") == F.col("ea")), "left").join(any_, F.col("filename") == F.col("nf"), "left")
    state = F.when(F.coalesce("filename", F.lit("")) == "", "general").when(F.col("ef").isNotNull() | (F.col("analyzed_at").isNull() & F.col("nf").isNotNull()), "currentAnalysis").when(F.col("nf").isNotNull() & F.col("analyzed_at").isNotNull(), "previousAnalysis").otherwise("analysisDeleted")
    return rows.select("id", state.alias("state"))


def class_suspects(classes: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings whose words hold a class by its full or its short name. Names are found as words, so the join is on equal
    words; a longer word is none. ``classes``: ``class_name``; ``findings``: ``id, text``."""
    names = classes.select("class_name", F.explode(F.array_distinct(F.array("class_name", F.substring_index("class_name", ".", -1)))).alias("word"))
    held = findings.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w$]+(?:\.[\w$]+)*)"), F.lit(1)))).alias("word"))
    return names.join(held, "word").select("class_name", "id").distinct()


def top_objects(rows: DataFrame, most: int = SHOWN_CLASSES) -> DataFrame:
    """The largest classes with their rank, and each one's share of all."""
    total = rows.agg(F.sum("retained").alias("all"))
    best = rows.orderBy(F.desc("retained"), "class_name").limit(most)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("retained"), "class_name")))
    # total is one row, and at most ``most`` rows are ranked
    return ranked.crossJoin(F.broadcast(total)).select("rank", "class_name", "retained", F.round(F.col("retained") * 100.0 / F.col("all"), 4).alias("percent"))


SORT_FIELDS = {"id": "id", "filename": "filename", "size": "file_size", "startedAt": "started_at"}


def spliced(prompt: Column, section: Column, mark: str = "\n== ") -> Column:
    """A section put before a prompt's first heading (one at its very start does not count), or at its end."""
    at = F.instr(prompt, mark)
    return F.when(section == "", prompt).when(at > 1, F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit("\n\n"), section, F.substring(prompt, at, F.length(prompt)))).otherwise(F.concat(prompt, F.lit("\n\n"), section))


def attached(base64: Column, most: int = ATTACHED_CHARS) -> Column:
    """The text of an attachment, cut to a length; null where it is none."""
    return F.substring(F.decode(F.try_to_binary(base64, F.lit("base64")), "UTF-8"), 1, most)


def sorted_page(rows: DataFrame, field: str, descending: bool, number: int, size: int, most: int = 200) -> DataFrame:
    """A page ordered by one of the known fields; any other name stands for the time of the start. Ties go by id."""
    column = F.col(SORT_FIELDS.get(field, "started_at"))
    size = min(max(size, 1), most)
    return rows.orderBy(column.desc() if descending else column.asc(), "id").offset(max(number, 0) * size).limit(size)


# ---- queries


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey")
    n = F.when(k == 0, key % 1024).when(k == 1, (key % 1000) * 1024).when(k == 2, (key % 500) * (1 << 20)).otherwise((key % 40) * (1 << 30))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n.cast("long").alias("n"))


_SIZES = "s AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN o_orderkey % 1000 * 1024 WHEN 2 THEN o_orderkey % 500 * 1048576 ELSE o_orderkey % 40 * 1073741824 END AS n FROM orders)"
_SHORT = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN n // 1024 || '.0 KB' WHEN n < 1073741824 THEN n // 1048576 || '.0 MB' ELSE n // 1073741824 || '.00 GB' END"


def fmt_bytes_variants(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return _sizes(spark, d).select("id", T.short_bytes(n).alias("short"), T.bytes_or_dash(F.when(F.col("id") % 5 != 0, n)).alias("dash"), T.about_bytes(n).alias("about"), T.signed_bytes(F.when(F.col("id") % 2 == 0, n).otherwise(-n)).alias("signed"))


def duration_words(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", T.duration_words((F.col("event_id") % 20_000) * 977 - 500).alias("text"))


def dump_time(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 4
    date = F.when(k == 3, F.lit(" soon ")).otherwise(text("2026. ", e % 12 + 1, ". ", e % 28 + 1, "."))
    time = F.when(k == 2, F.lit(None)).otherwise(text(F.when(e % 2 == 0, "오전").otherwise("오후"), " ", e % 12 + 1, "시 ", e % 60, "분 ", e % 59, "초"))
    return load(spark, d, "events").select("event_id", T.dump_time(date, time).alias("at"))


def names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 3
    name = F.when(k == 0, F.col("filename")).when(k == 1, F.concat(F.lit("."), F.col("id").cast("string"))).otherwise(F.concat(F.lit("a.b"), F.col("id").cast("string"), F.lit(".GZ")))
    return history(spark, d).select("id", T.strip_extension(name).alias("stem"), T.extension(name).alias("extension"))


def error_hint(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 6
    said = F.when(k == 0, text("x\njava.lang.OutOfMemoryError at ", e)).when(k == 1, F.lit("Access denied\nError opening heap dump")).when(k == 2, text("No such file ", e)).when(k == 3, text("an error ", e, "\n  some Exception ", e, "  \nlast line")).when(k == 4, F.concat(F.lit("ERROR "), F.repeat(F.lit("x"), 300))).otherwise(F.lit("fine"))
    return load(spark, d, "events").select("event_id", T.error_hint(said).alias("hint"))


def stderr_clean(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    said = F.concat(F.lit("*** banner\nNOTICE: x\n  first "), e, F.lit("\n\nSSH Connect to\nsecond\r\n third"), F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("y"), 400)).otherwise(""))
    return load(spark, d, "events").select("event_id", T.clean_stderr(said).alias("clean"), T.first_lines(said, 2).alias("first"))


def path_list(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    said = F.concat(F.lit(" /a\n/b\r\n\n/a\n"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/c\n/d\n/e\n/f\n/"), e)).otherwise(F.concat(F.lit("/"), e)))
    return load(spark, d, "events").select("event_id", F.array_join(T.path_list(said), ",").alias("paths"))


def log_truncate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.md5(T.cut_log(F.col("text"), 500)).alias("md5"))


def client_ip(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    headers = [F.when(k == 0, F.concat(F.lit("10.0.0."), u, F.lit(" , 10.9.9.9"))).when(k == 1, "unknown").when(k == 2, ""), F.when(k == 1, F.concat(F.lit(" 10.1.1."), u))]
    return load(spark, d, "events").select("event_id", T.client_ip(headers, F.lit("127.0.0.1")).alias("ip"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    body = F.concat(F.lit('{"summary": "s'), e, F.lit('", "severity": "HIGH"}'))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).when(k == 2, F.concat(F.lit("no object "), F.repeat(F.lit("z"), 1000))).otherwise(F.concat(F.lit("{broken "), e, F.lit("}")))
    return load(spark, d, "events").select("event_id", T.salvaged(reply).alias("s")).select("event_id", "s.summary", "s.severity")


def insight_summary(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    data = (
        F.when(k == 0, F.concat(F.lit('{"summary": " short '), e, F.lit(' ", "recommendations": ["a'), e, F.lit('", "b"]}')))
        .when(k == 1, F.concat(F.lit('{"summary": "", "rootCause": "'), F.repeat(F.lit("c"), 60), F.lit('", "recommendations": "do '), e, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"rootCause": "r'), e, F.lit('"}')))
        .otherwise(F.lit("no json"))
    )
    return load(spark, d, "events").select("event_id", T.insight_summary(data).alias("s")).select("event_id", "s.summary", "s.recommendations")


def http_errors(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (400, 401, 403, 404, 418, 429, 500, 503))), (F.col("event_id") % 8 + 1).cast("int"))
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("http://h/v1/"), u)).when(k == 1, F.concat(F.lit(" http://h/"), u, F.lit("/?a=1"))).when(k == 2, "http://h/completions?x").when(k == 3, "http://h/v1/messages").otherwise("")
    return load(spark, d, "events").select("event_id", T.http_error(code).alias("error"), T.completions_url(url).alias("url"))


def fallback_hash(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_nationkey", T.two_hashes(F.col("n_name")).alias("hash"))


def component_summary(spark: SparkSession, d: str) -> DataFrame:
    remarks = component_remarks(F.col("shallow") / 10, F.col("supp") % 3, F.col("retained") * 10_000, F.when(F.col("part") % 4 == 0, F.lit(200_000)).otherwise(F.col("part") % 5))
    return A.objects(spark, d).select("report_id", "ordinal", F.array_join(remarks, ",").alias("remarks"))


def heap_usage_query(spark: SparkSession, d: str) -> DataFrame:
    rows = A.objects(spark, d).withColumn("total_heap", F.when(F.col("report_id") % 5 == 0, F.lit(0)).otherwise(F.lit(1 << 32))).withColumn("stated", F.col("report_id"))
    return heap_usage(rows).withColumn("percent", F.round("percent", 6))


def heap_check_query(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("id") % 5, F.col("used_heap")
    files = history(spark, d).select("id", F.when(k == 0, n).alias("working"), F.when(k == 1, n * 2).alias("plain"), F.when(k > 1, n).alias("packed"), F.when(k == 2, n * 3).alias("recorded"), F.when(k == 3, n * 4).otherwise(F.lit(1)).alias("trailer"))
    return heap_check(files, 30_000_000)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files: a dump per supplier, and numbered copies of some."""
    s = F.col("s_suppkey")
    rows = load(spark, d, "supplier").select(s, (s * 10).alias("size"), F.md5(s.cast("string")).alias("hash"))
    extra = F.when(s % 3 == 0, F.array(F.lit(""), F.lit("_2"), F.lit("_3"), F.lit("_5"))).when(s % 3 == 1, F.array(F.lit(""), F.lit("_3"))).otherwise(F.array(F.lit("")))
    return rows.select(s, "size", "hash", F.explode(extra).alias("extra")).select(F.concat(F.lit("d"), s.cast("string"), "extra", F.lit(".hprof")).alias("name"), "size", "hash")


def upload_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    k = c % 3
    uploads = load(spark, d, "customer").select(c.alias("id"), F.concat(F.lit("d"), c.cast("string"), F.lit(".hprof")).alias("name"), F.when(k == 0, c * 10).otherwise(F.lit(-1)).alias("size"), F.md5(F.when(k == 0, c).otherwise(F.lit(0)).cast("string")).alias("hash"))
    return upload_status(uploads, _files(spark, d))


def core_list_query(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey").cast("string")
    k = F.col("s_suppkey") % 4
    own = F.when(k == 0, F.array(F.concat(F.lit("core."), s), F.concat(F.lit("core."), s, F.lit(".exec")))).when(k == 1, F.array(F.concat(F.lit(".core."), s))).when(k == 2, F.array(F.concat(F.lit("lone"), s, F.lit(".exec")))).otherwise(F.array(F.concat(F.lit("core."), s)))
    files = load(spark, d, "supplier").select(F.explode(own).alias("name"), F.col("s_suppkey").alias("size"))
    done = load(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("core."), s).alias("name"), F.lit("SUCCESS").alias("status"))
    return core_list(files, done)


#: In the query: values from which on a copy is kept, and from which on it is analysed.
KEPT_FROM, ANALYSED_FROM = 10, 60


def scan_status_query(spark: SparkSession, d: str) -> DataFrame:
    """Events as scans and as transfers: a scan of a path of which the transfer log may hold a copy."""
    e = load(spark, d, "events")
    path = F.concat(F.lit("/r/"), (F.col("event_id") % 900).cast("string"))
    scanned = e.select((F.col("event_id") % 7).alias("server_id"), path.alias("path"), (F.col("event_id") % 900).alias("size"), F.col("ts").alias("mtime"))
    log = e.select("value", F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("server_id"), path.alias("remote"), (F.col("event_id") % 900).alias("file_size"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"), F.col("ts").alias("started_at"))
    # copies of small value are gone, those of large value have been analysed
    local = log.where(F.col("value") >= KEPT_FROM).select("filename")
    return scan_status(scanned, log.drop("value"), local, log.where(F.col("value") >= ANALYSED_FROM).select("filename"))


def chat_state_query(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d).select("id", "filename", "analyzed_at")
    k = F.col("id") % 6
    sessions = h.select("id", F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("gone_"), "filename")).otherwise(F.col("filename")).alias("filename"), F.when(k == 2, F.lit(None)).when(k == 3, F.col("analyzed_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("analyzed_at")).alias("analyzed_at"))
    return chat_state(sessions, h)


def chat_purge(spark: SparkSession, d: str) -> DataFrame:
    """Messages that stay when the chats of every third dump are deleted; a chat is about the dump of its number."""
    gone = history(spark, d).where("id % 3 = 0").select(F.col("id").alias("conv_id"))
    return load(spark, d, "conversations").join(gone, "conv_id", "left_anti").select("conv_id", "turn")


def comparison_list(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons of a dump and the next one, newest first, with which of the two is gone."""
    h = history(spark, d).select("id", "file_deleted", "analyzed_at")
    there = h.where("NOT file_deleted").select(F.col("id").alias("there"))
    pairs = h.select(F.col("id").alias("base"), (F.col("id") + 1).alias("target"), "analyzed_at")
    rows = pairs.join(there.withColumnRenamed("there", "tb"), F.col("base") == F.col("tb"), "left").join(there.withColumnRenamed("there", "tt"), F.col("target") == F.col("tt"), "left")
    return rows.select("base", "target", F.col("tb").isNull().alias("base_missing"), F.col("tt").isNull().alias("target_missing"))


def class_suspects_query(spark: SparkSession, d: str) -> DataFrame:
    classes = load(spark, d, "supplier").select(text("com.acme.C", F.col("s_suppkey")).alias("class_name"))
    findings = A.objects(spark, d).select((F.col("report_id") * 64 + F.col("ordinal")).alias("id"), F.when(F.col("part") % 2 == 0, text("one com.acme.C", F.col("supp"), ", and more")).otherwise(text("of C", F.col("supp"), " and C", F.col("supp"), "x")).alias("text"))
    return class_suspects(classes, findings)


def class_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Classes of a report with their row in the histogram of all, which one row of each name stands for."""
    rows = load(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("."), "p_type").alias("class_name"))
    return rows.join(histogram(spark, d, 1996), "class_name", "left").select("p_partkey", "class_name", F.coalesce("objects", F.lit(0)).alias("objects"))


def history_time_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Dump times of stored rows: where there is none and the analysis went well, that of its report."""
    h = history(spark, d).withColumn("dump_time", F.when(F.col("id") % 3 == 0, F.date_format("analyzed_at", "yyyy-MM-dd")))
    reports = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("rid")).agg(F.min("l_shipdate").alias("shipped"))
    rows = h.join(reports, F.col("id") == F.col("rid"), "left")
    return rows.select("id", F.when(F.col("dump_time").isNull() & (F.col("status") == "SUCCESS"), F.date_format("shipped", "yyyy-MM-dd")).otherwise(F.col("dump_time")).alias("dump_time"))


def files_union(spark: SparkSession, d: str) -> DataFrame:
    """Dumps and cores in one list, with what only one of them has."""
    dumps = history(spark, d).select(F.col("filename").alias("name"), F.lit("heap").alias("kind"), "used_heap")
    cores = load(spark, d, "supplier").select(text("core.", F.col("s_suppkey")).alias("name"), F.lit("core").alias("kind"), (F.col("s_suppkey") % 32).alias("signal"))
    return dumps.unionByName(cores, allowMissingColumns=True)


def gz_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Packed files whose unpacked original is there as well."""
    every = history(spark, d).select(F.explode(F.when(F.col("id") % 8 == 2, F.array("filename", F.regexp_replace("filename", r"\.gz$", ""))).otherwise(F.array("filename"))).alias("name"))
    packed = every.where(F.col("name").endswith(".gz")).withColumn("plain", F.regexp_replace("name", r"\.gz$", ""))
    return packed.join(every.select(F.col("name").alias("plain")), "plain", "left_semi").select("name")


def history_join(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows, files without a stored row, and cached results that neither knows, with the newest insight of each."""
    stored = history(spark, d).select("id", "filename", F.lit("stored").alias("origin"))
    files = load(spark, d, "part").select((F.col("p_partkey") * 8).alias("id"), text("dump_", F.col("p_partkey") * 8, ".hprof").alias("filename"))
    cached = load(spark, d, "customer").select((F.col("c_custkey") * 12).alias("id"), text("dump_", F.col("c_custkey") * 12, ".hprof").alias("filename"))
    known = stored.unionByName(files.join(stored, "filename", "left_anti").withColumn("origin", F.lit("file")))
    every = known.unionByName(cached.join(known, "filename", "left_anti").withColumn("origin", F.lit("cache")))
    insight = load(spark, d, "events").groupBy(text("dump_", F.col("event_id") % 2000 * 4, ".hprof").alias("filename")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("insight"))
    return every.join(insight, "filename", "left").select("filename", "origin", "insight")


def account_search(spark: SparkSession, d: str) -> DataFrame:
    """Accounts whose name holds the text, of one state; an unknown state is no criterion."""
    state = lambda s: F.col("c_mktsegment") == s if s in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE") else None
    rows = load(spark, d, "customer")
    return matching(rows, [F.lower("c_name").like("%1%"), state("BUILDING"), state("nothing")]).select("c_custkey", "c_name")


def histogram_search(spark: SparkSession, d: str) -> DataFrame:
    return histogram(spark, d, 1996).where(F.lower("class_name").contains("brand#1")).select("class_name", "objects", "retained")


def servers_due(spark: SparkSession, d: str) -> DataFrame:
    """Servers whose last scan is older than an hour before the newest event."""
    rows = transfers(spark, d)
    last = rows.groupBy("server_id").agg(F.max("started_at").alias("last"))
    now = rows.agg(F.max("started_at").alias("now"))
    return last.crossJoin(F.broadcast(now)).where(F.unix_micros("now") - F.unix_micros("last") > 3_600_000_000).select("server_id")


def report_model(spark: SparkSession, d: str) -> DataFrame:
    """What a printed report shows: the five largest objects of each report, rounded percents."""
    w = Window.partitionBy("report_id").orderBy(F.desc("retained"), "ordinal")
    rows = A.objects(spark, d).withColumn("rank", F.row_number().over(w)).withColumn("all", F.sum("retained").over(Window.partitionBy("report_id")))
    return rows.where("rank <= 5").select("report_id", "rank", "retained", F.floor(F.col("retained") * 1000.0 / F.col("all") + 0.5).cast("long").alias("per_mille"))


def prompt_splice(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    prompt = F.when(k == 0, F.concat(F.lit("Look at "), e, F.lit("\n== A ==\nx\n== B =="))).when(k == 1, F.concat(F.lit("\n== A ==\n"), e)).otherwise(e)
    return load(spark, d, "events").select("event_id", spliced(prompt, F.when(F.col("event_id") % 4 == 0, "").otherwise("S")).alias("prompt"))


def attachments(spark: SparkSession, d: str) -> DataFrame:
    sent = F.when(F.col("doc_id") % 5 == 0, F.lit("no base64!")).otherwise(F.base64(F.encode("text", "UTF-8")))
    return load(spark, d, "documents").select("doc_id", F.md5(attached(sent, 1000)).alias("md5"))


_H, _T = f"WITH {HISTORY_SQL}", f"WITH {TRANSFERS_SQL}"
_HIST96 = "h AS (SELECT p_brand || '.' || p_type AS class_name, count(*) AS objects, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS retained FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1996 GROUP BY 1)"
QUERIES = {
    "fmt_bytes_variants": (fmt_bytes_variants, f"WITH {_SIZES} SELECT id, {_SHORT} AS short, CASE WHEN id % 5 = 0 THEN '-' ELSE {_SHORT} END AS dash, 'about ' || CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN n // 1024 || '.0KB' WHEN n < 1073741824 THEN n // 1048576 || '.0MB' ELSE n // 1073741824 || '.0GB' END AS about, CASE WHEN n = 0 THEN '0 B' ELSE CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END || {_SHORT} END AS signed FROM s"),
    "duration_words": (duration_words, "WITH s AS (SELECT event_id, (event_id % 20000 * 977 - 500) AS ms, (event_id % 20000 * 977 - 500) // 1000 AS s FROM events) SELECT event_id, CASE WHEN ms < 0 THEN '-' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'min ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'min' END AS text FROM s"),
    "dump_time": (dump_time, "WITH p AS (SELECT event_id AS e, event_id % 12 + 1 AS h, event_id % 2 = 1 AS pm FROM events) SELECT e AS event_id, CASE WHEN e % 4 = 3 THEN 'soon' ELSE '2026-' || lpad(CAST(e % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(e % 28 + 1 AS VARCHAR), 2, '0') END || CASE WHEN e % 4 = 2 THEN '' ELSE ' ' || lpad(CAST(CASE WHEN pm AND h <> 12 THEN h + 12 WHEN NOT pm AND h = 12 THEN 0 ELSE h END AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 59 AS VARCHAR), 2, '0') END AS at FROM p"),
    "name_parts": (names, f"{_H} SELECT id, CASE id % 3 WHEN 0 THEN 'dump_' || id WHEN 1 THEN '.' || id ELSE 'a' END AS stem, CASE WHEN id % 3 = 0 THEN CASE id % 4 WHEN 0 THEN 'hprof' WHEN 1 THEN 'bin' WHEN 2 THEN 'gz' ELSE '' END WHEN id % 3 = 1 THEN '' ELSE 'GZ' END AS extension FROM history"),
    "error_hint": (error_hint, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'more memory' WHEN 1 THEN 'damaged dump' WHEN 2 THEN 'no file' WHEN 3 THEN 'some Exception ' || event_id WHEN 4 THEN 'ERROR ' || repeat('x', 194) || '...' ELSE '' END AS hint FROM events"),
    "stderr_clean": (stderr_clean, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ('first ' || event_id || ' second third' || repeat('y', 400))[:300] || '...' ELSE 'first ' || event_id || ' second third' END AS clean, '*** banner | NOTICE: x (+4)' AS first FROM events"),
    "path_list": (path_list, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/a,/b,/c,/d,/e' ELSE '/a,/b,/' || event_id END AS paths FROM events"),
    "log_truncate": (log_truncate, "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN text[:500] || chr(10) || '... (' || length(text) || ' characters)' ELSE text END) AS md5 FROM documents"),
    "client_ip": (client_ip, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.1.1.' || user_id ELSE '127.0.0.1' END AS ip FROM events"),
    "json_salvage": (json_salvage, "SELECT event_id, CASE event_id % 4 WHEN 2 THEN ('no object ' || repeat('z', 1000))[:1000] || '...' WHEN 3 THEN '{broken ' || event_id || '}' ELSE 's' || event_id END AS summary, CASE WHEN event_id % 4 < 2 THEN 'HIGH' ELSE 'Unknown' END AS severity FROM events"),
    "insight_summary": (insight_summary, f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'short ' || event_id WHEN 1 THEN repeat('c', {T.SUMMARY_CHARS - 1}) || '…' WHEN 2 THEN 'r' || event_id END AS summary, CASE event_id % 4 WHEN 0 THEN 'a' || event_id || ' / b' WHEN 1 THEN 'do ' || event_id END AS recommendations FROM events"),
    "http_errors": (http_errors, "SELECT event_id, ['BAD_REQUEST', 'AUTH_ERROR', 'AUTH_ERROR', 'NOT_FOUND', 'HTTP_418', 'RATE_LIMIT', 'SERVER_ERROR', 'SERVER_ERROR'][event_id % 8 + 1] AS error, CASE event_id % 5 WHEN 0 THEN 'http://h/v1/' || user_id || '/chat/completions' WHEN 1 THEN 'http://h/' || user_id || '/chat/completions?a=1' WHEN 2 THEN 'http://h/completions?x' WHEN 3 THEN 'http://h/v1/messages' ELSE '' END AS url FROM events"),
    "fallback_hash": (fallback_hash, None),
    "component_summary": (component_summary, f"WITH {OBJECTS_SQL}, x AS (SELECT *, CASE WHEN part % 4 = 0 THEN 200000 ELSE part % 5 END AS n FROM objects) SELECT report_id, ordinal, concat_ws(',', CASE WHEN shallow >= 300 THEN 'large share' WHEN shallow >= 100 THEN 'notable share' WHEN shallow > 0 THEN 'normal share' END, CASE WHEN supp % 3 > 0 THEN supp % 3 || ' warnings' END, CASE WHEN n > 0 AND retained * 10000 / n > 1048576 THEN 'large objects' WHEN n > 100000 THEN 'many objects' END) AS remarks FROM x"),
    "heap_usage": (heap_usage_query, f"WITH {OBJECTS_SQL}, s AS (SELECT report_id, CAST(sum(retained) AS BIGINT) AS top FROM objects GROUP BY 1) SELECT report_id, CASE WHEN report_id % 5 = 0 THEN report_id ELSE top END AS used, CASE WHEN report_id % 5 = 0 THEN 0 ELSE 4294967296 - top END AS free, CASE WHEN report_id % 5 <> 0 THEN round(top * 100.0 / 4294967296, 6) END AS percent FROM s"),
    "heap_check": (heap_check_query, f"{_H}, s AS (SELECT id, used_heap * (id % 5 + 1) AS raw, CASE id % 5 WHEN 0 THEN used_heap WHEN 1 THEN used_heap * 2 WHEN 2 THEN used_heap * 3 WHEN 3 THEN used_heap * 4 ELSE used_heap END AS n FROM history) SELECT id, n AS size, n * 2 > 30000000 AS warning, CASE WHEN n * 2 < 1048576 THEN printf('%.1f', n * 2 / 1024.0) || ' KB' WHEN n * 2 < 1073741824 THEN printf('%.2f', n * 2 / 1048576.0) || ' MB' ELSE regexp_replace(printf('%.2f', n * 2 / 1073741824.0), '\\.?0+$', '') || ' GB' END AS recommended FROM s"),
    "upload_dedup": (upload_dedup, "WITH k AS (SELECT c_custkey AS c, c_custkey % 3 AS k, s_suppkey IS NOT NULL AS there FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey) SELECT c AS id, CASE WHEN there AND k = 0 THEN 'DUPLICATE_CONTENT' WHEN there THEN 'DUPLICATE_NAME' ELSE 'OK' END AS status, CASE WHEN there AND k = 0 THEN 'd' || c || '.hprof' WHEN there THEN 'd' || c || '.hprof' END AS existing, CASE WHEN there AND k <> 0 THEN 'd' || c || '_2.hprof' END AS suggested FROM k"),
    "core_list": (core_list_query, "SELECT 'core.' || s_suppkey AS name, s_suppkey AS size, CASE WHEN s_acctbal > 0 THEN 'SUCCESS' ELSE 'NOT_ANALYZED' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'core.' || s_suppkey || '.exec' END AS program FROM supplier WHERE s_suppkey % 4 IN (0, 3)"),
    "core_filter": (
        lambda s, d: core_filter(core_list_query(s, d), "CORE.1", "SUCCESS", True),
        "SELECT 'core.' || s_suppkey AS name, s_suppkey AS size, 'SUCCESS' AS status, 'core.' || s_suppkey || '.exec' AS program FROM supplier WHERE s_suppkey % 4 = 0 AND s_acctbal > 0 AND contains('core.' || s_suppkey, 'core.1')",
    ),
    "scan_status": (
        scan_status_query,
        f"""WITH s AS (SELECT DISTINCT event_id % 7 AS server_id, '/r/' || event_id % 900 AS path, event_id % 900 AS size FROM events),
 m AS (SELECT event_id % 7 AS server_id, '/r/' || event_id % 900 AS path, max_by(event_id, (ts, event_id)) AS e, max_by(value, (ts, event_id)) AS v FROM events WHERE value >= {KEPT_FROM} AND event_type <> 'error' GROUP BY 1, 2)
 SELECT s.server_id, s.path, s.size, CASE WHEN e IS NOT NULL THEN 'f' || e END AS copy, CASE WHEN v >= {ANALYSED_FROM} THEN 'ANALYZED' WHEN e IS NOT NULL THEN 'TRANSFERRED' ELSE 'NEW' END AS state FROM s LEFT JOIN m ON s.server_id = m.server_id AND s.path = m.path""",
    ),
    "chat_state": (chat_state_query, f"{_H} SELECT id, CASE id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'analysisDeleted' WHEN 3 THEN 'previousAnalysis' ELSE 'currentAnalysis' END AS state FROM history"),
    "chat_purge": (chat_purge, "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)"),
    "comparison_list": (comparison_list, f"{_H} SELECT h.id AS base, h.id + 1 AS target, h.file_deleted AS base_missing, coalesce(n.file_deleted, true) AS target_missing FROM history h LEFT JOIN history n ON n.id = h.id + 1"),
    "class_suspects": (class_suspects_query, f"WITH {OBJECTS_SQL} SELECT DISTINCT 'com.acme.C' || supp AS class_name, report_id * 64 + ordinal AS id FROM objects JOIN supplier ON supp = s_suppkey"),
    "class_lookup": (class_lookup, f"WITH {_HIST96} SELECT p_partkey, p_brand || '.' || p_type AS class_name, coalesce(objects, 0) AS objects FROM part LEFT JOIN h ON h.class_name = p_brand || '.' || p_type"),
    "history_time_backfill": (history_time_backfill, f"{_H}, r AS (SELECT l_orderkey AS rid, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1) SELECT id, CASE WHEN id % 3 = 0 THEN strftime(analyzed_at, '%Y-%m-%d') WHEN status = 'SUCCESS' THEN strftime(shipped, '%Y-%m-%d') END AS dump_time FROM history LEFT JOIN r ON id = rid"),
    "files_union": (files_union, f"{_H} SELECT filename AS name, 'heap' AS kind, used_heap, CAST(NULL AS BIGINT) AS signal FROM history UNION ALL SELECT 'core.' || s_suppkey, 'core', NULL, s_suppkey % 32 FROM supplier"),
    "gz_duplicates": (gz_duplicates, f"{_H} SELECT filename AS name FROM history WHERE id % 8 = 2"),
    "history_join": (
        history_join,
        f"""{_H}, f AS (SELECT 'dump_' || p_partkey * 8 || '.hprof' AS filename FROM part), c AS (SELECT 'dump_' || c_custkey * 12 || '.hprof' AS filename FROM customer),
 e AS (SELECT filename, 'stored' AS origin FROM history UNION ALL SELECT filename, 'file' FROM f WHERE filename NOT IN (SELECT filename FROM history) UNION ALL SELECT filename, 'cache' FROM c WHERE filename NOT IN (SELECT filename FROM history) AND filename NOT IN (SELECT filename FROM f)),
 i AS (SELECT 'dump_' || event_id % 2000 * 4 || '.hprof' AS filename, max_by(event_type, (ts, event_id)) AS insight FROM events GROUP BY 1) SELECT e.filename, origin, insight FROM e LEFT JOIN i ON e.filename = i.filename""",
    ),
    "account_search": (account_search, "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' AND c_mktsegment = 'BUILDING'"),
    "histogram_search": (histogram_search, f"WITH {_HIST96} SELECT * FROM h WHERE contains(lower(class_name), 'brand#1')"),
    "servers_due": (servers_due, f"{_T} SELECT server_id FROM transfers GROUP BY 1 HAVING epoch_us((SELECT max(started_at) FROM transfers)) - epoch_us(max(started_at)) > 3600000000"),
    "top_objects": (lambda s, d: top_objects(histogram(s, d, 1996)), f"WITH {_HIST96} SELECT CAST(row_number() OVER (ORDER BY retained DESC, class_name) AS INTEGER) AS rank, class_name, retained, round(retained * 100.0 / (SELECT sum(retained) FROM h), 4) AS percent FROM h QUALIFY rank <= {SHOWN_CLASSES}"),
    "sorted_page": (lambda s, d: sorted_page(transfers(s, d), "size", True, 1, 30).select("id", "file_size"), f"{_T} SELECT id, file_size FROM transfers ORDER BY file_size DESC, id LIMIT 30 OFFSET 30"),
    "report_model": (report_model, f"WITH {OBJECTS_SQL}, r AS (SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY retained DESC, ordinal) AS INTEGER) AS rank, retained, sum(retained) OVER (PARTITION BY report_id) AS a FROM objects) SELECT report_id, rank, retained, CAST(floor(CAST(retained AS DOUBLE) * 1000.0 / CAST(a AS DOUBLE) + 0.5) AS BIGINT) AS per_mille FROM r WHERE rank <= 5"),
    "prompt_splice": (prompt_splice, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'Look at ' || event_id || chr(10) || '== A ==' || chr(10) || 'x' || chr(10) || '== B ==' WHEN 1 THEN chr(10) || '== A ==' || chr(10) || event_id ELSE CAST(event_id AS VARCHAR) END WHEN event_id % 3 = 0 THEN 'Look at ' || event_id || chr(10) || chr(10) || 'S' || chr(10) || '== A ==' || chr(10) || 'x' || chr(10) || '== B ==' WHEN event_id % 3 = 1 THEN chr(10) || '== A ==' || chr(10) || event_id || chr(10) || chr(10) || 'S' ELSE event_id || chr(10) || chr(10) || 'S' END AS prompt FROM events"),
    "attachments": (attachments, "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(text[:1000]) END AS md5 FROM documents"),
}
