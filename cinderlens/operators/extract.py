"""Typed rows out of diagnostic text: thread dumps, debugger output, scan listings and names. Each function takes a
DataFrame with a text or a line per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.functions import html as H
from cinderlens.functions.steps import worked_out
from cinderlens.plans import artifacts as A
from cinderlens.plans.artifacts import INSTANCES_AT, OBJECTS_SQL, THREAD_SQL, text
from cinderlens.plans.views import HISTORY_SQL, history
from cinderlens.sources.stored import new_folder, stored
from cinderlens.sources.tables import load

#: How a debugger's echoed section marks begin, and a frame with address, function, arguments and the rest; fixed values.
SECTION_MARK = "===SECTION:"
FRAME = r"#(\d+)\s+(0x[0-9a-fA-F]+\s+in\s+|)(\S+)\s*\(([^)]*)\)(.*)"
#: Lines of libraries, registers and threads, and frames of Java stacks; fixed values.
LIBRARY = r"^(0x[0-9a-fA-F]+)\s+(0x[0-9a-fA-F]+)\s+(Yes(?:\s+\(\*\))?|No)\s+(\S+)"
#: A table of frames and local variables, and its rows; fixed values.
LOCALS_TABLE = r'(?is)<table[^>]*class="[^"]*\bresult\b[^"]*"[^>]*>' + H.upto("</table>")
TABLE_ROW = "(?is)<tr([^>]*)>" + H.upto("</tr>")
#: Words of the lines that an output's head is read from; fixed values.
HEAD_WORDS = ("GNU gdb", "Core was generated by", "Program terminated with signal")
REGISTER = r"^(\w+)\s+(0x[0-9a-fA-F]+)"
THREAD = r"^\s*(\*?)\s*(\d+)\s+(Thread\s+\S+(?:\s+\(LWP\s+\d+\))?)\s*(.*)"
THREAD_MARK = "Thread 0x"
JAVA_FRAME = r"^at\s+([\w$.]+)\.([\w$<>]+)\(([^)]*)\)$"
#: Packages of frames of the platform and of frameworks; fixed values.
PLATFORM = r"^(java\.|javax\.|jdk\.|sun\.|com\.sun\.)"
FRAMEWORK = r"^(org\.springframework\.|org\.apache\.|com\.fasterxml\.|io\.netty\.|org\.hibernate\.|jakarta\.)"
#: Ends of names of heap dumps; fixed values.
DUMP_ENDS = (".hprof", ".bin", ".dump", ".hprof.gz", ".bin.gz", ".dump.gz")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


# ---- thread dumps


def thread_blocks(rows: DataFrame) -> DataFrame:
    """One row per thread: lower-case address, the frames before its locals, and the block."""
    # what stands before the first mark is no thread's; the mark is put back
    pieces = F.slice(F.split("text", THREAD_MARK), F.lit(2), F.lit((1 << 31) - 1))
    blocks = rows.select("report_id", F.explode(pieces).alias("piece")).select("report_id", F.concat(F.lit(THREAD_MARK), "piece").alias("block"))
    stack = F.trim(F.substring_index("block", "locals:", 1))
    blocks = worked_out(blocks, address=F.lower(F.regexp_extract("block", "^Thread (0x[0-9a-fA-F]+)", 1)), stack=F.regexp_replace(F.trim(F.regexp_replace(stack, "^[^\n]*\n?", "")), r"\s++$", ""))
    return blocks.select("report_id", "address", "stack", "block")


def thread_locals(rows: DataFrame) -> DataFrame:
    """Distinct ids of local objects of each thread, as unsigned decimals."""
    found = thread_blocks(rows).select("report_id", "address", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("block"), F.lit("objectid=0x([0-9a-f]+)"), F.lit(1)))).alias("hex"))
    return found.select("report_id", "address", F.conv("hex", 16, 10).alias("object_id"))


def thread_stacks(threads: DataFrame, dump: DataFrame) -> DataFrame:
    """Threads of a report with the stack that the dump holds for their address."""
    stacks = thread_blocks(dump).where("stack <> ''").select("report_id", "address", "stack")
    return threads.join(stacks, ["report_id", "address"])


def frame_owner(frame: Column) -> Column:
    """Whose code a frame is: an error's own, the platform's, a framework's, or the user's."""
    package = F.lower(F.regexp_extract(frame, r"^at\s+([\w$.]+)\.", 1))
    return F.when(frame.contains("OutOfMemoryError") | frame.contains("NullPointerException"), "oom").when(package.rlike(PLATFORM), "jdk").when(package.rlike(FRAMEWORK), "framework").otherwise("user")


def local_rows(pages: DataFrame) -> DataFrame:
    """The rows of a table of frames with their local variables, in order: ``nth, kind, name, state, daemon, loader, raw,
    local_heap, significant``. The columns are found by the header, and stand at fixed places without it; a first selected
    row that is no frame is the thread's, and a row of totals is none."""
    table = F.regexp_extract("html", LOCALS_TABLE, 1)
    heads = F.transform(H.header_cells(F.regexp_extract("table", "(?is)<thead[^>]*>" + H.upto("</thead>"), 1)), lambda h: F.lower(F.trim(h)))
    own = lambda test, default: F.coalesce(F.array_max(F.transform("heads", lambda h, i: F.when(test(h), i))), F.lit(default))
    columns = {
        "heap": own(lambda h: h.contains("max") & h.contains("local"), 4),
        "name": own(lambda h: h == "name", 1),
        "state": own(lambda h: h == "state", 8),
        "daemon": own(lambda h: h.contains("daemon"), 6),
        "loader": own(lambda h: h.contains("context") & h.contains("loader"), 5),
    }
    parts = F.arrays_zip(F.regexp_extract_all("table", F.lit(TABLE_ROW), F.lit(1)).alias("marks"), F.regexp_extract_all("table", F.lit(TABLE_ROW), F.lit(2)).alias("row"))
    rows = worked_out(worked_out(worked_out(pages, table=table), heads=heads), **{f"c_{n}": c for n, c in columns.items()}).select("report_id", *(f"c_{n}" for n in columns), F.posexplode(parts).alias("pos", "r"))
    rows = worked_out(rows, cells=H.cells(F.col("r.row"))).where("size(cells) > 0").where(~F.col("r.marks").rlike(r"(?i)class\s*=\s*[\"'][^\"']*\btotals\b"))
    rows = rows.withColumn("significant", F.col("r.marks").rlike(r"(?i)class\s*=\s*[\"'][^\"']*\bselected\b"))
    rows = worked_out(rows, full=H.decoded(H.plain(F.get("cells", F.lit(0)))), link=H.decoded(H.plain(F.regexp_extract(F.get("cells", F.lit(0)), "(?is)<a[^>]*>(.*?)</a>", 1))))
    squeezed = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*»\s*$", ""), r"\s{2,}", " "))
    rows = worked_out(rows, shown=squeezed(F.when(F.col("link") != "", F.col("link")).otherwise(F.col("full"))))
    first = F.row_number().over(Window.partitionBy("report_id").orderBy("pos")) == 1
    frame, local = F.col("shown").rlike(r"^at\s+[\w$.]"), F.col("full").contains("Java Local") | F.col("full").rlike(r"^\|[+|]")
    rows = worked_out(rows.withColumn("first", first), kind=F.when(F.col("first") & F.col("significant") & ~F.col("shown").rlike(r"^at\s+"), "thread").when(frame, frame_owner(F.col("shown"))).when(local, "local")).where("kind IS NOT NULL")
    cell = lambda n: F.coalesce(H.plain(F.get("cells", F.col(f"c_{n}"))), F.lit(""))
    thread, framed = F.col("kind") == "thread", ~F.col("kind").isin("thread", "local")
    raw = F.when(framed, F.col("shown")).when(F.col("kind") == "local", squeezed(F.regexp_replace("full", r"^[|+\s]+", "")))
    heap = F.when(framed, F.coalesce(F.regexp_extract(F.regexp_replace(cell("heap"), r"[,\s]", ""), r"^(\d+)", 1).try_cast("long"), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("report_id").orderBy("pos"))
    return rows.select("report_id", nth.alias("nth"), "kind", *(F.when(thread, cell(n)).alias(n) for n in ("name", "state", "daemon", "loader")), raw.alias("raw"), heap.alias("local_heap"), "significant")


def java_frames(rows: DataFrame) -> DataFrame:
    """Frames of stacks in order, with package, class, method, file and line, and whose code it is."""
    lines = rows.select("report_id", "address", F.posexplode(F.filter(F.transform(F.split("stack", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^at\s+[\w$.]"))).alias("pos", "frame"))
    detail = JAVA_FRAME
    path, method, place = (F.regexp_extract("frame", detail, i) for i in (1, 2, 3))
    owner = frame_owner(F.col("frame"))
    numbered = place.rlike(r"^.+:\d+$")
    return lines.select("report_id", "address", "pos", F.regexp_extract(path, r"^(.*)\.[^.]*$", 1).alias("package"), F.substring_index(path, ".", -1).alias("class"), method.alias("method"), F.when(numbered, F.regexp_extract(place, r"^(.+):\d+$", 1)).otherwise(place).alias("file"), F.when(numbered, F.substring_index(place, ":", -1)).otherwise("").alias("line"), owner.alias("owner"))


# ---- debugger output


def gdb_sections(lines: DataFrame) -> DataFrame:
    """Lines with the name of the section that they stand in; marks and lines before the first one are left out."""
    mark = F.when(F.col("line").startswith(SECTION_MARK), F.trim(F.replace(F.substring("line", len(SECTION_MARK) + 1, 99), F.lit("==="), F.lit(""))))
    w = Window.partitionBy("report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("mark", mark).withColumn("section", F.last("mark", ignorenulls=True).over(w))
    return out.where("mark IS NULL AND section IS NOT NULL").select("report_id", "section", "pos", "line")


def gdb_heads(lines: DataFrame) -> DataFrame:
    """Version, program, signal and its description of each output."""
    heads = reduce(lambda a, b: a | b, (F.col("line").contains(w) for w in HEAD_WORDS))
    # all other lines of an output become one row
    rows = lines.select("report_id", F.when(heads, F.col("pos")).alias("pos"), F.when(heads, F.col("line")).alias("line")).distinct()
    first = lambda pattern, i=1: F.min_by(F.trim(F.regexp_extract("line", pattern, i)), F.when(F.col("line").rlike(pattern), F.col("pos")))
    return rows.groupBy("report_id").agg(first(r"^GNU gdb.*?(\d+\.\d+[\d.]*)").alias("version"), first("Core was generated by `(.+?)'").alias("program"), first(r"Program terminated with signal (\S+),\s*(.+)").alias("signal"), first(r"Program terminated with signal (\S+),\s*(.+)", 2).alias("description"))


#: What is said of an output that is of no use, by kind; fixed values.
GDB_MESSAGES = {
    "kernel": "vmcore는 Linux 커널 크래시 덤프입니다. GDB로는 분석할 수 없으며, 'crash' 유틸리티로 분석하세요.",
    "format": "파일 형식을 인식할 수 없습니다. 유효한 코어 덤프 파일(.core, core.PID 등)인지 확인하세요. 일반 실행 파일이나 로그 파일은 분석할 수 없습니다.",
    "missing": "코어 덤프 파일 또는 실행 파일을 찾을 수 없습니다. 파일이 삭제되었거나 경로가 올바르지 않습니다.",
    "no core file": "코어 덤프 파일 형식이 아닙니다. GDB가 지원하는 코어 덤프 파일(.core, core.PID)인지 확인하세요.",
}


def gdb_errors(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Why an output is of no use, by its first line that says so: ``kind, message``. A missing source file, named after a
    number, is no reason. ``names``: ``report_id, name`` of the cores; one of a kernel is known by its name."""
    line = F.trim("line")
    missing = line.contains("No such file or directory")
    kind = F.when(missing & line.rlike(r"^\d+"), None).when(line.contains("is not a core dump") | line.contains("file format not recognized"), "format").when(missing, "missing").when(line.contains("not a core file"), "no core file")
    found = lines.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("report_id").agg(F.min_by("kind", "pos").alias("kind")).join(names, "report_id", "left")
    shown = F.when((F.col("kind") == "format") & F.lower("name").startswith("vmcore"), "kernel").otherwise(F.col("kind"))
    said = F.create_map(*(F.lit(x) for pair in GDB_MESSAGES.items() for x in pair))
    return found.select("report_id", shown.alias("kind")).withColumn("message", said[F.col("kind")])


def frames(lines: DataFrame) -> DataFrame:
    """Frames with address, function, arguments, place, library and quality; other lines are dropped."""
    rows = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike(r"^#\d+\s+\S"))
    kept = [c for c in rows.columns if c != "line"]
    part = lambda i: F.col(f"part_{i}")
    rows = worked_out(rows, **{f"part_{i}": F.regexp_extract("line", FRAME, i) for i in range(1, 6)})
    hit, rest = part(1) != "", F.trim(part(5))
    rows = worked_out(
        rows,
        number=F.regexp_extract("line", r"#(\d+)", 1).cast("int"),
        address=_filled(F.regexp_extract(part(2), "(0x[0-9a-fA-F]+)", 1)),
        function=F.when(hit, part(3)).otherwise(F.trim(F.regexp_extract("line", r"#\d+\s+(.+)", 1))),
        args=F.when(hit, F.trim(part(4))),
        location=F.when(rest.startswith("at "), F.trim(F.substring(rest, 4, 1 << 30))),
        library=F.when(rest.startswith("from "), F.trim(F.substring(rest, 6, 1 << 30))),
    ).select(*kept, "number", "address", "function", "args", "location", "library")
    known = (F.col("function") != "??") | F.col("location").isNotNull() | F.col("library").isNotNull()
    return worked_out(rows, quality=F.when(known, "RESOLVED").when(garbage(F.col("address")), "GARBAGE").otherwise("UNSYMBOLIZED"))


def garbage(address: Column) -> Column:
    """Whether a 64-bit address is stack content: at least six printable bytes, or all bytes equal."""
    hex_ = F.regexp_replace(F.trim(address), "^0[xX]", "")
    values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hex_, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    printable = F.size(F.filter(values, lambda b: b.between(0x20, 0x7E)))
    return F.when(F.coalesce(hex_, F.lit("")).rlike("^[0-9a-fA-F]{16}$"), (printable >= 6) | (F.size(F.array_distinct(values)) == 1)).otherwise(False)


def gdb_libraries(lines: DataFrame) -> DataFrame:
    pattern = LIBRARY
    return lines.where(F.col("line").rlike(pattern)).select("report_id", "pos", *(F.regexp_extract("line", pattern, i).alias(c) for i, c in enumerate(("start", "stop", "symbols", "path"), 1)))


def gdb_registers(lines: DataFrame) -> DataFrame:
    """The last value of each register."""
    pattern = REGISTER
    rows = lines.where(F.trim("line").rlike(pattern)).select("report_id", "pos", F.regexp_extract(F.trim("line"), pattern, 1).alias("register"), F.regexp_extract(F.trim("line"), pattern, 2).alias("value"))
    return rows.groupBy("report_id", "register").agg(F.max_by("value", "pos").alias("value"))


def gdb_threads(lines: DataFrame) -> DataFrame:
    """Threads, the current one first, then by number."""
    pattern = THREAD
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.where(F.col("line").rlike(pattern)).select("report_id", part(2).cast("int").alias("id"), (part(1) == "*").alias("current"), F.trim(part(3)).alias("target"), F.trim(part(4)).alias("frame"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("current"), "id")))


def gdb_locals(lines: DataFrame) -> DataFrame:
    """Frames of a full backtrace with the lines that follow each as its locals."""
    w = Window.partitionBy("report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_frame = F.trim("line").rlike(r"^#\d+\s+\S")
    rows = lines.withColumn("nth", F.sum(is_frame.cast("int")).over(w)).where("nth > 0").withColumn("number", F.when(is_frame, F.regexp_extract(F.trim("line"), r"^#(\d+)", 1).cast("int")))
    # the lines of one frame
    held = F.array_sort(F.collect_list(F.when(~is_frame & (F.trim("line") != ""), F.struct("pos", F.trim("line").alias("line")))))
    return rows.groupBy("report_id", "nth").agg(F.max("number").alias("number"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("locals"))


def crash_confidence(framed: DataFrame, libraries: DataFrame) -> DataFrame:
    """Frames, resolved and damaged ones, the first resolved function, and the confidence in each output: low without
    resolved frames, middle if three in ten are damaged, no library has symbols or fewer than three are resolved."""
    is_ = lambda q: F.col("quality") == q
    out = framed.groupBy("report_id").agg(F.count("*").alias("frames"), F.count_if(is_("RESOLVED")).alias("resolved"), F.count_if(is_("GARBAGE")).alias("garbage"), F.min_by("function", F.when(is_("RESOLVED"), F.col("pos"))).alias("first_resolved"))
    symbols = libraries.groupBy("report_id").agg(F.bool_or(F.col("symbols").startswith("Yes")).alias("symbols"))
    out = out.join(symbols, "report_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit(False)))
    share = F.try_divide(F.col("garbage"), F.col("frames"))
    return out.withColumn("confidence", F.when(F.col("resolved") == 0, "LOW").when((share >= 0.3) | ~F.col("symbols") | (F.col("resolved") < 3), "MEDIUM").otherwise("HIGH"))


#: Words in a debugger's output, and what they mean for the quality of what is read from it; fixed values.
NO_LIBRARIES, NO_SYMBOLS, NO_MEMORY, REGISTERS_CUT, NO_MAPPING = "No shared libraries loaded at this time", "No symbol table info available", "Cannot access memory at address", (".reg-xstate", "too small"), "Can't open file (null) during file-backed mapping"
QUALITY_WARNINGS = (
    "공유 라이브러리 정보 없음 — 실행 파일/라이브러리 경로가 코어와 매칭되지 않습니다.",
    "디버그 심볼 없음 — stripped 바이너리이거나 일치하는 실행 파일이 페어링되지 않았습니다.",
    "일부 메모리 접근 불가 — 코어가 부분 저장(truncated)되었거나 매핑이 누락되었습니다.",
    "레지스터 확장 상태(xstate) 일부 손상 — 레지스터 값 신뢰도가 낮을 수 있습니다.",
    "파일 기반 매핑 노트 처리 실패 — 원본 실행 환경의 파일을 찾을 수 없습니다.",
)
DAMAGED_STACK = ("스택이 손상되어 백트레이스 대부분(", ")이 무효 프레임입니다 — 스택 스캔 노이즈로 추정됩니다.")
#: Registers of a prompt, in this order; fixed value.
PROMPT_REGISTERS = ("rip", "rsp", "rbp", "rax", "rbx", "rsi", "rdi", "pc", "sp", "lr")


def quality_warnings(lines: DataFrame, framed: DataFrame, libraries: DataFrame) -> DataFrame:
    """``report_id, warnings``: what lowers the confidence in each output, in a fixed order."""
    has = lambda *words: F.bool_or(reduce(lambda a, b: a & b, (F.col("line").contains(w) for w in words)))
    # words of one note may stand on different lines
    said = lines.groupBy("report_id").agg(has(NO_LIBRARIES).alias("none"), has(NO_SYMBOLS).alias("bare"), has(NO_MEMORY).alias("memory"), (has(REGISTERS_CUT[0]) & has(REGISTERS_CUT[1])).alias("cut"), has(NO_MAPPING).alias("mapping"))
    counts = framed.groupBy("report_id").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == "RESOLVED").alias("resolved"), F.count_if(F.col("quality") == "GARBAGE").alias("garbage"))
    rows = said.join(counts, "report_id", "left").join(libraries.select("report_id", F.lit(True).alias("loaded")).distinct(), "report_id", "left").na.fill(0, ["total", "resolved", "garbage"])
    flags = (F.col("none") | F.col("loaded").isNull(), (F.col("resolved") == 0) | F.col("bare"), F.col("memory"), F.col("cut"), F.col("mapping"))
    damaged = F.when((F.col("total") > 100) & (F.col("garbage") >= F.col("total") * 0.5), F.concat(F.lit(DAMAGED_STACK[0]), F.col("garbage").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(DAMAGED_STACK[1])))
    return rows.select("report_id", F.array_compact(F.array(*(F.when(f, F.lit(w)) for f, w in zip(flags, QUALITY_WARNINGS, strict=True)), damaged)).alias("warnings"))


def crash_summary(framed: DataFrame, most: int = 5) -> DataFrame:
    """Text of the first five resolved frames, or of the first five where none is."""
    shown = F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), F.coalesce(F.concat("address", F.lit(" in ")), F.lit("")), F.col("function"), F.coalesce(F.concat(F.lit(" at "), "location"), F.lit("")))
    resolved = F.col("quality") == "RESOLVED"
    of = Window.partitionBy("report_id")
    rows = framed.withColumn("shown", shown).withColumn("some", F.max(resolved).over(of)).where(~F.col("some") | resolved)
    rows = rows.withColumn("nth", F.row_number().over(of.orderBy("pos"))).where(F.col("nth") <= most)
    return rows.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda x: x["shown"]), "\n").alias("summary"))


#: Frames of a prompt; fixed value.
PROMPT_FRAMES = 12


def crash_prompt(heads: DataFrame, confidence: DataFrame, framed: DataFrame, registers: DataFrame, warnings: DataFrame) -> DataFrame:
    """The facts of a crash as lines for a model: signal, program, confidence and what lowers it, at most twelve resolved
    frames, and the main registers in their order."""
    resolved = framed.where("quality = 'RESOLVED'").withColumn("nth", F.row_number().over(Window.partitionBy("report_id").orderBy("pos"))).where(F.col("nth") <= PROMPT_FRAMES)
    stack = resolved.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), F.col("function")).alias("f")))), lambda x: x["f"]), "\n").alias("stack"))
    place = F.array_position(F.array(*(F.lit(r) for r in PROMPT_REGISTERS)), F.col("register"))
    main = registers.withColumn("nth", place).where("nth > 0").groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat("register", F.lit("="), "value").alias("r")))), lambda x: x["r"]), "\n").alias("registers"))
    rows = heads.join(confidence, "report_id").join(stack, "report_id", "left").join(main, "report_id", "left").join(warnings, "report_id", "left")
    why = F.when(F.size("warnings") > 0, F.array_join("warnings", "\n"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    return rows.select("report_id", F.concat_ws("\n", line("Signal", F.concat_ws(" ", "signal", "description")), line("Program", F.col("program")), line("Confidence", F.concat("confidence", F.lit(" ("), F.col("resolved").cast("string"), F.lit("/"), F.col("frames").cast("string"), F.lit(")"))), why, "stack", "registers").alias("prompt"))


# ---- listings and names


def scan_lines(rows: DataFrame) -> DataFrame:
    """``mtime|date|size|path`` lines; the path may hold the separator; lines that do not parse are dropped."""
    cut = F.split("line", r"\|", 4)
    path = F.get(cut, F.lit(3))
    return rows.select("id", F.get(cut, F.lit(0)).try_cast("double").alias("mtime"), F.get(cut, F.lit(2)).try_cast("long").alias("size"), path.alias("path"), F.substring_index(path, "/", -1).alias("filename")).where("mtime IS NOT NULL AND size IS NOT NULL AND path IS NOT NULL")


def executables(rows: DataFrame) -> DataFrame:
    """``path: description`` lines of a file-type tool: the program that a core came from, its command, and what is amiss."""
    rows = rows.where(F.instr("line", ": ") > 0).withColumn("path", F.trim(F.substring_index("line", ": ", 1))).withColumn("what", F.expr("substring(line, instr(line, ': ') + 2)"))
    denied = F.col("what").contains("Permission denied") | F.col("what").contains("cannot open")
    program, command = _filled(F.regexp_extract("what", r"execfn:\s*'([^']+)'", 1)), _filled(F.regexp_extract("what", r"from\s+'([^']+)'", 1))
    amiss = F.when(denied, "denied").when(program.isNotNull(), None).when(command.isNotNull(), "command only").when(F.col("what").contains("core file"), "no program").otherwise("no core file")
    return rows.select("id", "path", F.when(~denied, program).alias("program"), F.when(~denied, command).alias("command"), amiss.alias("amiss"))


def file_type(name: Column) -> Column:
    """Whether a name is that of a core file, a heap dump or something else."""
    low = F.lower(name)
    dump = F.lit(False)
    for end in DUMP_ENDS:
        dump = dump | low.endswith(end)
    return F.when(low.rlike(r"^core$|^core\.|\.core$"), "coredump").when(dump, "heapdump").otherwise("others")


def filename_valid(name: Column) -> Column:
    """No separators, no parent steps, no null byte, not empty."""
    return ~(name.isNull() | (F.trim(name) == "") | name.contains("..") | name.contains("/") | name.contains("\\") | name.contains("\0"))


def section_tree(rows: DataFrame, levels: range = range(1, 7)) -> DataFrame:
    """The parent of each section: the nearest earlier one of a smaller level. One pass that carries the last position of
    each level."""
    w = Window.partitionBy("report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("pos"))).over(w)) for k in levels]
    return rows.select("report_id", "pos", "level", F.greatest(*last).alias("parent"))


# ---- queries


def _sections(spark: SparkSession, d: str, *names: str):
    """The lines of some sections by name: the outputs are cut into sections once, and what is wanted is stored by section."""
    rows = stored(gdb_sections(A.gdb_lines(spark, d)).where(F.col("section").isin(*names)), new_folder(spark, "sections"), ("section",))
    return lambda name: rows.where(F.col("section") == name)


def _confidence(spark: SparkSession, d: str) -> DataFrame:
    part = _sections(spark, d, "bt", "sharedlibrary")
    return crash_confidence(frames(part("bt")), gdb_libraries(part("sharedlibrary")))


def _warnings(spark: SparkSession, d: str) -> DataFrame:
    part = _sections(spark, d, "bt", "sharedlibrary")
    rows = quality_warnings(A.gdb_lines(spark, d), frames(part("bt")), gdb_libraries(part("sharedlibrary")))
    return rows.withColumn("warnings", F.array_join("warnings", "\n"))


def _prompt(spark: SparkSession, d: str) -> DataFrame:
    part = _sections(spark, d, "bt", "sharedlibrary", "registers")
    lines, framed, libraries = A.gdb_lines(spark, d), frames(part("bt")), gdb_libraries(part("sharedlibrary"))
    return crash_prompt(gdb_heads(lines), crash_confidence(framed, libraries), framed, gdb_registers(part("registers")), quality_warnings(lines, framed, libraries))


def _names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 9
    base = F.col("filename")
    name = F.when(k == 0, F.concat(F.lit("core."), F.col("id").cast("string"))).when(k == 1, F.concat(F.lit("a/"), base)).when(k == 2, F.concat(F.lit("x.."), base)).when(k == 3, F.upper(base)).when(k == 4, F.lit(" ")).when(k == 5, F.concat(F.lit("my"), F.col("id").cast("string"), F.lit(".core"))).when(k == 6, F.concat(F.lit("a\\"), base)).otherwise(base)
    return history(spark, d).select("id", name.alias("name"))


_NAMES_SQL = rf"{HISTORY_SQL}, n AS (SELECT id, CASE id % 9 WHEN 0 THEN 'core.' || id WHEN 1 THEN 'a/' || filename WHEN 2 THEN 'x..' || filename WHEN 3 THEN upper(filename) WHEN 4 THEN ' ' WHEN 5 THEN 'my' || id || '.core' WHEN 6 THEN 'a\' || filename ELSE filename END AS name FROM history)"


def _scan(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 5
    size = F.when(k == 1, F.lit("x")).otherwise(e.cast("string"))
    line = F.when(k == 2, F.lit("broken|line")).otherwise(text(F.lit("17"), F.lpad(e.cast("string"), 8, "0"), ".5|2024-01-01 10:00|", size, "|/d/u", F.col("user_id"), F.when(k == 3, "|x").otherwise(""), "/f", e, ".hprof"))
    return load(spark, d, "events").select(e.alias("id"), line.alias("line"))


def _described(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 6
    what = (
        F.when(k == 0, text("ELF 64-bit LSB core file, from 'app -x ", e, "', execfn: '/bin/app", e, "', platform"))
        .when(k == 1, text("ELF core file, from 'app ", e, "'"))
        .when(k == 2, F.lit("cannot open `x' (Permission denied), execfn: '/no'"))
        .when(k == 3, F.lit("ELF 64-bit core file x86"))
        .when(k == 4, F.lit("ASCII text"))
    )
    return load(spark, d, "events").select(e.alias("id"), F.coalesce(F.concat(text("/c/core.", e, ": "), what), F.lit("no colon here")).alias("line"))


def _section(name: str):
    return lambda spark, d: gdb_sections(A.gdb_lines(spark, d)).where(F.col("section") == name)


def _threads(spark: SparkSession, d: str) -> DataFrame:
    return A.objects(spark, d).select("report_id", A.thread_address().alias("address"), text("worker-", F.col("supp")).alias("name"))


_AT = "'0x00007f' || lpad(printf('%x', part * 4096 + supp), 10, '0')"
_STACK_LINES = "'at app.M' || part || '.run(M.java:' || ordinal || ')'"
_STACK_SQL = f"""CASE part % 8 WHEN 0 THEN 'at java.lang.OutOfMemoryError.<init>()V' || chr(10) || '  at java.lang.Thread.start0(Native Method)' || chr(10) || '  ' WHEN 1 THEN 'at java.nio.Bits.reserveMemory(Bits.java:1)' || chr(10) || '  ' WHEN 2 THEN 'java.lang.OutOfMemoryError: GC overhead limit exceeded' || chr(10) || '  ' WHEN 3 THEN 'at java.lang.OutOfMemoryError.<init>()V' || chr(10) || '  '
 WHEN 4 THEN 'at my.OutOfMemoryError.x()V' || chr(10) || '  ' WHEN 5 THEN 'at java.lang.OutOfMemoryError.<init>()V' || chr(10) || '  at java.lang.ClassLoader.defineClass1(Native Method)' || chr(10) || '  ' WHEN 6 THEN 'java.lang.OutOfMemoryError: something odd' || chr(10) || '  ' ELSE '' END || {_STACK_LINES} || CASE WHEN part % 16 = 8 THEN chr(10) || '  Caused by: java.lang.OutOfMemoryError: Metaspace' ELSE '' END"""
_FRAMED = f"""f AS (SELECT report_id, 1000 + ordinal * 10 AS pos, ordinal - 1 AS number, CASE part % 6 WHEN 0 THEN {_AT} WHEN 2 THEN '0x4142434445464748' WHEN 3 THEN {_AT} END AS address,
 CASE WHEN part % 6 IN (0, 1) THEN 'fn' || supp WHEN part % 6 IN (2, 3) THEN '??' WHEN part % 6 = 4 THEN '<signal handler called>' ELSE 'operator new (sz=' || part || ')' END AS function, CASE part % 6 WHEN 0 THEN 'a=1, b=2' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' END AS args,
 CASE WHEN part % 6 = 0 THEN 'f' || part || '.c:10' END AS location, CASE WHEN part % 6 = 1 THEN '/lib/l' || supp || '.so' END AS library, CASE part % 6 WHEN 2 THEN 'GARBAGE' WHEN 3 THEN 'UNSYMBOLIZED' ELSE 'RESOLVED' END AS quality, part FROM objects)"""
_OWN_FRAME = "'app' AS package, 'M' || part AS class, 'run' AS method, 'M.java' AS file, CAST(ordinal AS VARCHAR) AS line, 'user' AS owner"
def _locals_page(spark: SparkSession, d: str) -> DataFrame:
    """A thread with a frame and a local variable per line; even reports have a header with another order of columns."""
    part, supp, even = F.col("part"), F.col("supp"), F.col("report_id") % 2 == 0
    cells = lambda *c: F.concat(*(F.concat(F.lit("<td>"), x if isinstance(x, Column) else F.lit(x), F.lit("</td>")) for x in c))
    thread = F.concat(F.lit('<tr class="x selected">'), cells(text("java.lang.Thread @ 0x", part)), F.when(even, cells("", text("w", supp), "RUNNABLE", "false", text("app.L", part))).otherwise(cells(text("w", supp), "", "", "9", text("app.L", part), "false", "x", "RUNNABLE")), F.lit("</tr>"))
    owner = F.when(part % 4 == 0, "java.util.M").when(part % 4 == 1, "org.springframework.M").when(part % 4 == 2, "app.OutOfMemoryError").otherwise("app.M")
    heap = A.grouped(F.col("shallow"))
    frame = F.concat(F.when(part % 3 == 0, '<tr class="selected">').otherwise("<tr>"), cells(F.concat(F.lit('<a href="x">at '), owner, text(".run(M.java:", part, ")</a> &raquo;"))), F.when(even, cells(heap)).otherwise(cells("", "", "", heap)), F.lit("</tr>"))
    local = F.concat(F.lit("<tr>"), cells(F.when(part % 2 == 0, text("&lt;Java Local&gt;   app.C", supp, " &raquo;")).otherwise(text("|+ app.D", supp))), F.lit("</tr>"))
    row = F.concat(F.when(F.col("ordinal") == 1, thread).otherwise(""), frame, local, F.when(part % 5 == 0, "<tr><td>other</td></tr>").otherwise(""))
    pages = A.joined(A.objects(spark, d), "report_id", row)
    head = F.when(even, "<thead><tr><th>Object</th><th>Max. Locals' Retained Heap</th><th>Name</th><th>State</th><th>Is Daemon</th><th>Context Class Loader</th></tr></thead>").otherwise("")
    return pages.withColumn("html", F.concat(F.lit('<table class="result">'), head, F.lit("<tbody>"), F.col("html"), F.lit('<tr class="totals"><td>Total: 3</td></tr></tbody></table>')))


_WARNED = f"""w AS (SELECT o.report_id, concat_ws(chr(10), CASE WHEN bool_and(part % 3 = 0) THEN '{QUALITY_WARNINGS[0]}' END, CASE WHEN any_value(o.report_id) % 5 = 1 OR coalesce(any_value(known), 0) = 0 THEN '{QUALITY_WARNINGS[1]}' END, CASE any_value(o.report_id) % 5 WHEN 0 THEN '{QUALITY_WARNINGS[2]}' WHEN 2 THEN '{QUALITY_WARNINGS[3]}' WHEN 3 THEN '{QUALITY_WARNINGS[4]}' END) AS warnings
 FROM objects o LEFT JOIN (SELECT report_id, count(*) FILTER (quality = 'RESOLVED') AS known FROM f GROUP BY 1) q ON q.report_id = o.report_id GROUP BY o.report_id)"""
QUERIES = {
    "thread_blocks": (lambda s, d: thread_blocks(A.thread_dump(s, d)).drop("block"), f"WITH {OBJECTS_SQL} SELECT report_id, {THREAD_SQL} AS address, {_STACK_SQL} AS stack FROM objects"),
    "thread_locals": (lambda s, d: thread_locals(A.thread_dump(s, d)), f"WITH {OBJECTS_SQL} SELECT report_id, {THREAD_SQL} AS address, CASE WHEN part % 3 = 0 THEN CAST(part AS VARCHAR) ELSE CAST({INSTANCES_AT}::HUGEINT + supp AS VARCHAR) END AS object_id FROM objects"),
    "thread_stacks": (lambda s, d: thread_stacks(_threads(s, d), A.thread_dump(s, d)), f"WITH {OBJECTS_SQL} SELECT report_id, {THREAD_SQL} AS address, 'worker-' || supp AS name, {_STACK_SQL} AS stack FROM objects"),
    "local_variables": (
        lambda s, d: local_rows(_locals_page(s, d)),
        f"""WITH {OBJECTS_SQL}, r AS (SELECT report_id, 0 AS o, 'thread' AS kind, 'w' || supp AS name, 'RUNNABLE' AS state, 'false' AS daemon, 'app.L' || part AS loader, NULL AS raw, NULL AS local_heap, true AS significant FROM objects WHERE ordinal = 1
 UNION ALL SELECT report_id, ordinal * 2, CASE part % 4 WHEN 0 THEN 'jdk' WHEN 1 THEN 'framework' WHEN 2 THEN 'oom' ELSE 'user' END, NULL, NULL, NULL, NULL, 'at ' || CASE part % 4 WHEN 0 THEN 'java.util.M' WHEN 1 THEN 'org.springframework.M' WHEN 2 THEN 'app.OutOfMemoryError' ELSE 'app.M' END || '.run(M.java:' || part || ')', shallow, part % 3 = 0 FROM objects
 UNION ALL SELECT report_id, ordinal * 2 + 1, 'local', NULL, NULL, NULL, NULL, CASE WHEN part % 2 = 0 THEN '<Java Local> app.C' ELSE 'app.D' END || supp, NULL, false FROM objects)
 SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY o) AS INTEGER) AS nth, kind, name, state, daemon, loader, raw, local_heap, significant FROM r""",
    ),
    "stack_frames": (
        lambda s, d: java_frames(thread_blocks(A.thread_dump(s, d))),
        f"""WITH {OBJECTS_SQL}, o AS (SELECT *, {THREAD_SQL} AS address FROM objects), i AS (SELECT report_id, address, part, ordinal, part % 8 AS k FROM o)
 SELECT report_id, address, CASE WHEN k IN (0, 5) THEN 2 WHEN k IN (1, 3, 4) THEN 1 ELSE 0 END AS pos, {_OWN_FRAME} FROM i
 UNION ALL SELECT report_id, address, 0, '', '', '', '', '', 'oom' FROM i WHERE k IN (0, 3, 4, 5)
 UNION ALL SELECT report_id, address, 1, 'java.lang', 'Thread', 'start0', 'Native Method', '', 'jdk' FROM i WHERE k = 0
 UNION ALL SELECT report_id, address, 0, 'java.nio', 'Bits', 'reserveMemory', 'Bits.java', '1', 'jdk' FROM i WHERE k = 1
 UNION ALL SELECT report_id, address, 1, 'java.lang', 'ClassLoader', 'defineClass1', 'Native Method', '', 'jdk' FROM i WHERE k = 5""",
    ),
    "gdb_sections": (lambda s, d: gdb_sections(A.gdb_lines(s, d)).groupBy("report_id", "section").agg(F.count("*").alias("lines"), F.min("pos").alias("first")), f"WITH {OBJECTS_SQL}, c AS (SELECT report_id, count(*) AS n FROM objects GROUP BY 1) SELECT report_id, unnest(['bt', 'bt_full', 'registers', 'sharedlibrary', 'threads']) AS section, unnest([n, 2 * n, n, n, n]) AS lines, unnest([1010, 2010, 3010, 4010, 5010]) AS first FROM c"),
    "gdb_heads": (lambda s, d: gdb_heads(A.gdb_lines(s, d)), "SELECT DISTINCT l_orderkey AS report_id, '12.1' AS version, 'app' || l_orderkey || ' -x' AS program, CASE WHEN l_orderkey % 5 > 1 THEN 'SIGSEGV' END AS signal, CASE WHEN l_orderkey % 5 > 1 THEN 'Segmentation fault.' END AS description FROM lineitem"),
    "gdb_errors": (
        lambda s, d: gdb_errors(A.gdb_lines(s, d), A.core_names(s, d)),
        "WITH k AS (SELECT DISTINCT l_orderkey AS report_id, CASE WHEN l_orderkey % 5 = 0 THEN 'missing' WHEN l_orderkey % 22 = 0 THEN 'kernel' WHEN l_orderkey % 11 = 0 THEN 'format' WHEN l_orderkey % 11 = 1 THEN 'no core file' END AS kind FROM lineitem) SELECT report_id, kind, CASE kind " + " ".join("WHEN '" + k + "' THEN '" + m.replace("'", "''") + "'" for k, m in GDB_MESSAGES.items()) + " END AS message FROM k WHERE kind IS NOT NULL",
    ),
    "quality_warnings": (_warnings, f"WITH {OBJECTS_SQL}, {_FRAMED}, {_WARNED} SELECT report_id, warnings FROM w"),
    "gdb_frames": (lambda s, d: frames(_section("bt")(s, d)).drop("section"), f"WITH {OBJECTS_SQL}, {_FRAMED} SELECT report_id, pos, number, address, function, args, location, library, quality FROM f"),
    "gdb_libs": (lambda s, d: gdb_libraries(_section("sharedlibrary")(s, d)), f"WITH {OBJECTS_SQL} SELECT report_id, 4000 + ordinal * 10 AS pos, {_AT} AS start, '0x00007fffffffffff' AS stop, CASE WHEN part % 3 = 1 THEN 'Yes (*)' ELSE 'No' END AS symbols, '/lib/l' || supp || '.so' AS path FROM objects WHERE part % 3 <> 0"),
    "gdb_registers": (lambda s, d: gdb_registers(_section("registers")(s, d)), f"WITH {OBJECTS_SQL} SELECT report_id, CASE ordinal % 3 WHEN 0 THEN 'rax' WHEN 1 THEN 'rip' ELSE 'r8' END AS register, '0x' || printf('%x', max_by(part, ordinal)) AS value FROM objects GROUP BY 1, 2"),
    "gdb_threads": (lambda s, d: gdb_threads(_section("threads")(s, d)), f"WITH {OBJECTS_SQL} SELECT report_id, ordinal AS id, ordinal = 2 AS current, 'Thread 0x7f' || part || ' (LWP ' || supp || ')' AS target, 'fn' || supp || ' ()' AS frame, CAST(row_number() OVER (PARTITION BY report_id ORDER BY ordinal <> 2, ordinal) AS INTEGER) AS place FROM objects"),
    "gdb_locals": (lambda s, d: gdb_locals(_section("bt_full")(s, d)), f"WITH {OBJECTS_SQL} SELECT report_id, CAST(ordinal AS BIGINT) AS nth, ordinal - 1 AS number, 'x = ' || part AS locals FROM objects"),
    "garbage_addr": (lambda s, d: A.objects(s, d).select("report_id", "ordinal", garbage(F.when(F.col("part") % 4 == 0, F.lit("0x2020202020202020")).when(F.col("part") % 4 == 1, text("0x414243444546", F.lpad(F.lower(F.hex(F.col("part") % 65536)), 4, "0"))).when(F.col("part") % 4 == 2, text("0x", F.lpad(F.hex(F.col("part")), 16, "0"))).otherwise(F.lit("zz"))).alias("garbage")), f"WITH {OBJECTS_SQL} SELECT report_id, ordinal, CASE part % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS garbage FROM objects"),
    "crash_confidence": (
        _confidence,
        f"""WITH {OBJECTS_SQL}, {_FRAMED}, c AS (SELECT report_id, count(*) AS frames, count(*) FILTER (quality = 'RESOLVED') AS resolved, count(*) FILTER (quality = 'GARBAGE') AS garbage, min_by(function, pos) FILTER (quality = 'RESOLVED') AS first_resolved, bool_or(part % 3 = 1) AS symbols FROM f GROUP BY 1)
 SELECT *, CASE WHEN resolved = 0 THEN 'LOW' WHEN garbage / frames >= 0.3 OR NOT symbols OR resolved < 3 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM c""",
    ),
    "crash_summary": (
        lambda s, d: crash_summary(frames(_section("bt")(s, d))),
        f"""WITH {OBJECTS_SQL}, {_FRAMED}, p AS (SELECT *, bool_or(quality = 'RESOLVED') OVER (PARTITION BY report_id) AS any_known FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS nth FROM p WHERE NOT any_known OR quality = 'RESOLVED')
 SELECT report_id, string_agg('#' || number || ' ' || coalesce(address || ' in ', '') || function || coalesce(' at ' || location, ''), chr(10) ORDER BY nth) AS summary FROM n WHERE nth <= 5 GROUP BY 1""",
    ),
    "crash_prompt": (
        _prompt,
        f"""WITH {OBJECTS_SQL}, {_FRAMED}, {_WARNED}, g AS (SELECT report_id, string_agg(r || '=0x' || printf('%x', v), chr(10) ORDER BY r DESC) AS regs FROM (SELECT report_id, CASE ordinal % 3 WHEN 0 THEN 'rax' ELSE 'rip' END AS r, max_by(part, ordinal) AS v FROM objects WHERE ordinal % 3 <> 2 GROUP BY 1, 2) GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS nth FROM f WHERE quality = 'RESOLVED'), k AS (SELECT report_id, string_agg('#' || number || ' ' || function, chr(10) ORDER BY nth) AS stack FROM n WHERE nth <= {PROMPT_FRAMES} GROUP BY 1),
 c AS (SELECT report_id, count(*) AS frames, count(*) FILTER (quality = 'RESOLVED') AS resolved, count(*) FILTER (quality = 'GARBAGE') AS garbage, bool_or(part % 3 = 1) AS symbols FROM f GROUP BY 1)
 SELECT c.report_id, concat_ws(chr(10), 'Signal: ' || CASE WHEN c.report_id % 5 > 1 THEN 'SIGSEGV Segmentation fault.' ELSE '' END, 'Program: app' || c.report_id || ' -x', 'Confidence: ' || CASE WHEN resolved = 0 THEN 'LOW' WHEN garbage / frames >= 0.3 OR NOT symbols OR resolved < 3 THEN 'MEDIUM' ELSE 'HIGH' END || ' (' || resolved || '/' || frames || ')', nullif(warnings, ''), stack, regs) AS prompt FROM c LEFT JOIN k ON c.report_id = k.report_id LEFT JOIN g ON c.report_id = g.report_id LEFT JOIN w ON c.report_id = w.report_id""",
    ),
    "frame_filter": (lambda s, d: java_frames(thread_blocks(A.thread_dump(s, d))).where("owner <> 'jdk' AND contains(lower(class), 'm')").select("report_id", "address", "pos", "class"), f"WITH {OBJECTS_SQL} SELECT report_id, {THREAD_SQL} AS address, CASE WHEN part % 8 IN (0, 5) THEN 2 WHEN part % 8 IN (1, 3, 4) THEN 1 ELSE 0 END AS pos, 'M' || part AS class FROM objects"),
    "scan_lines": (lambda s, d: scan_lines(_scan(s, d)), "SELECT event_id AS id, CAST('17' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '.5' AS DOUBLE) AS mtime, event_id AS size, '/d/u' || user_id || CASE WHEN event_id % 5 = 3 THEN '|x' ELSE '' END || '/f' || event_id || '.hprof' AS path, 'f' || event_id || '.hprof' AS filename FROM events WHERE event_id % 5 NOT IN (1, 2)"),
    "exec_detect": (lambda s, d: executables(_described(s, d)), "SELECT event_id AS id, '/c/core.' || event_id AS path, CASE WHEN event_id % 6 = 0 THEN '/bin/app' || event_id END AS program, CASE event_id % 6 WHEN 0 THEN 'app -x ' || event_id WHEN 1 THEN 'app ' || event_id END AS command, CASE event_id % 6 WHEN 1 THEN 'command only' WHEN 2 THEN 'denied' WHEN 3 THEN 'no program' WHEN 4 THEN 'no core file' END AS amiss FROM events WHERE event_id % 6 <> 5"),
    "file_type_class": (lambda s, d: _names(s, d).select("id", file_type(F.col("name")).alias("type")), f"WITH {_NAMES_SQL} SELECT id, CASE WHEN id % 9 IN (0, 5) THEN 'coredump' WHEN id % 9 <> 4 AND id % 4 <> 3 THEN 'heapdump' ELSE 'others' END AS type FROM n"),
    "filename_valid": (lambda s, d: _names(s, d).select("id", filename_valid(F.col("name")).alias("valid")), f"WITH {_NAMES_SQL} SELECT id, id % 9 NOT IN (1, 2, 4, 6) AS valid FROM n"),
    "section_tree": (lambda s, d: section_tree(A.objects(s, d).select("report_id", F.col("ordinal").alias("pos"), (F.col("part") % 4 + 1).cast("int").alias("level"))), f"WITH {OBJECTS_SQL}, s AS (SELECT report_id, ordinal AS pos, CAST(part % 4 + 1 AS INTEGER) AS level FROM objects) SELECT s.report_id, s.pos, s.level, max(u.pos) AS parent FROM s LEFT JOIN s u ON u.report_id = s.report_id AND u.pos < s.pos AND u.level < s.level GROUP BY 1, 2, 3"),
}
