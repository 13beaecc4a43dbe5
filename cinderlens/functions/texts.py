"""Small text rules as Column expressions: sizes, times, names, messages, lists and replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a tool's output and the hint they give, in the order in which they are tried; fixed values.
ERROR_HINTS = (
    ("more memory", ("outofmemoryerror", "java.lang.outofmemory")),
    ("damaged dump", ("snapshotexception", "error opening heap dump")),
    ("no permission", ("permission denied", "access denied")),
    ("no file", ("no such file", "file not found", "cannot find")),
    ("disk full", ("disk full", "no space left")),
)
#: Starts of lines that servers print on every connection; fixed values.
BANNERS = ("*", "NOTICE", "SSH Connect")
HINT_CHARS, STDERR_CHARS = 200, 300
SUMMARY_CHARS = 40


def _clipped(text: Column, most: int, end: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(end))).otherwise(text)


def _steps(n: Column, formats: tuple[tuple[float, str], ...], otherwise: Column) -> Column:
    out = otherwise
    for least, form in sorted(formats):
        out = F.when(n >= least, F.format_string(form, n / least)).otherwise(out)
    return out


def short_bytes(n: Column) -> Column:
    """One decimal for KB and MB, two for GB; bytes as they are, 0 as well."""
    return _steps(n, ((float(1 << 10), "%.1f KB"), (float(1 << 20), "%.1f MB"), (float(1 << 30), "%.2f GB")), F.concat(n.cast("string"), F.lit(" B")))


def bytes_or_dash(n: Column) -> Column:
    return F.when(n.isNull(), "-").otherwise(short_bytes(n))


def about_bytes(n: Column, word: str = "about ") -> Column:
    """Without a blank before the unit, one decimal, after a word."""
    return F.concat(F.lit(word), _steps(n, ((float(1 << 10), "%.1fKB"), (float(1 << 20), "%.1fMB"), (float(1 << 30), "%.1fGB")), F.concat(n.cast("string"), F.lit("B"))))


def signed_bytes(n: Column) -> Column:
    """A difference with its sign; 0 without one."""
    return F.when(n == 0, "0 B").otherwise(F.concat(F.when(n > 0, "+").otherwise("-"), short_bytes(F.abs(n))))


def duration_words(ms: Column) -> Column:
    """Seconds, minutes and hours in words; a dash for nothing."""
    s = F.floor(ms / 1000)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(ms.isNull() | (ms < 0), "-").when(s < 60, part(s, "s")).when(s < 3600, F.concat(part(F.floor(s / 60), "min "), part(s % 60, "s"))).otherwise(F.concat(part(F.floor(s / 3600), "h "), part(F.floor(s % 3600 / 60), "min")))


def dump_time(date: Column, time: Column, afternoon: str = "오후", marks: tuple[str, str, str] = ("시", "분", "초")) -> Column:
    """``2026. 5. 29.`` and a time with an am/pm word as ``2026-05-29 14:03:09``; what is not of that form stays."""
    pad = lambda n, size=2: F.lpad(n.cast("string"), size, "0")
    whole = r"^\s*(\d+)\.\s*(\d+)\.\s*(\d+)\s*\.?$"
    day = F.when(date.rlike(whole), F.concat_ws("-", pad(F.regexp_extract(date, whole, 1).try_cast("int"), 4), *(pad(F.regexp_extract(date, whole, i).try_cast("int")) for i in (2, 3)))).otherwise(F.trim(date))
    clock = rf"(\d+){marks[0]}\s*(\d+){marks[1]}\s*(\d+){marks[2]}"
    h, m, s = (F.regexp_extract(time, clock, i).try_cast("int") for i in (1, 2, 3))
    pm = time.contains(afternoon)
    hour = F.when(pm & (h != 12), h + 12).when(~pm & (h == 12), F.lit(0)).otherwise(h)
    at = F.when(time.rlike(clock), F.concat_ws(":", pad(hour), pad(m), pad(s))).otherwise(F.trim(time))
    return F.when(day.isNull() & at.isNull(), None).otherwise(F.concat_ws(" ", day, at))


def strip_extension(name: Column) -> Column:
    """Without ``.gz`` and the last extension; a leading dot is none."""
    bare = F.when(F.lower(name).endswith(".gz"), F.substring(name, F.lit(1), F.length(name) - 3)).otherwise(name)
    return F.regexp_replace(bare, r"(?s)^(.+)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)


def error_hint(output: Column) -> Column:
    """What a tool's output says went wrong: the first known sign, else its last line with exception or error in it."""
    low = F.lower(output)
    any_of = lambda parts: F.greatest(*(F.instr(low, p) for p in parts), F.lit(0)) > 0
    line = F.get(F.reverse(F.filter(F.transform(F.split(output, "\n"), lambda x: F.trim(x)), lambda x: F.lower(x).contains("exception") | F.lower(x).contains("error"))), F.lit(0))
    return F.coalesce(*(F.when(any_of(parts), F.lit(hint)) for hint, parts in ERROR_HINTS), _clipped(line, HINT_CHARS, "..."), F.lit(""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def clean_stderr(text: Column) -> Column:
    """Lines without banners, joined by blanks."""
    plain = lambda x: reduce(lambda a, start: a & ~x.startswith(start), BANNERS, x != "")
    lines = F.filter(_lines(text), lambda x: plain(x))
    return _clipped(F.array_join(lines, " "), STDERR_CHARS, "...")


def first_lines(text: Column, n: int) -> Column:
    """The first lines that are not blank, and how many more there are."""
    lines = F.filter(_lines(text), lambda x: x != "")
    more = F.size(lines) - n
    return F.concat(F.array_join(F.slice(lines, 1, n), " | "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def path_list(text: Column, most: int = 5) -> Column:
    """Distinct trimmed lines, the first few."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def cut_log(text: Column, most: int) -> Column:
    """A long log's beginning with a note of its length."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... ("), F.length(text).cast("string"), F.lit(" characters)"))).otherwise(text)


def client_ip(headers: list[Column], remote: Column) -> Column:
    """The first address of the first header that is set and not "unknown", else the connection's."""
    one = lambda h: F.when((h != "") & (F.lower(h) != "unknown"), F.trim(F.when(F.instr(h, ",") > 1, F.substring_index(h, ",", 1)).otherwise(h)))
    return F.coalesce(*map(one, headers), remote)


def reply_json(reply: Column) -> Column:
    """The JSON object in a model's reply, without fences and what stands around it; null if it is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"(?s)^```[a-zA-Z]*\s*", ""), r"(?s)\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    text = F.when(inner != "", inner).otherwise(bare)
    return F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), text)


def salvaged(reply: Column) -> Column:
    """Summary and severity of a reply: those of its JSON object, else the reply's first thousand characters and Unknown."""
    own = reply_json(reply)
    return F.when(own.isNotNull(), F.struct(F.get_json_object(own, "$.summary").alias("summary"), F.get_json_object(own, "$.severity").alias("severity"))).otherwise(F.struct(_clipped(reply, 1000, "...").alias("summary"), F.lit("Unknown").alias("severity")))


def insight_summary(data: Column, most: int = SUMMARY_CHARS) -> Column:
    """Summary (else the root cause) and recommendations of an insight; a list of them is joined. Nulls for no JSON."""
    field = lambda name: F.get_json_object(data, f"$.{name}")
    clip = lambda c: F.when(F.length(F.trim(c)) > most, F.concat(F.substring(F.trim(c), 1, most - 1), F.lit("…"))).otherwise(F.trim(c))
    summary = F.when(F.coalesce(field("summary"), F.lit("")) == "", field("rootCause")).otherwise(field("summary"))
    raw = field("recommendations")
    listed = F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), " / ")).otherwise(raw)
    return F.struct(clip(summary).alias("summary"), clip(listed).alias("recommendations"))


def http_error(code: Column) -> Column:
    """The class of a failed call."""
    return F.when(code.isin(401, 403), "AUTH_ERROR").when(code == 404, "NOT_FOUND").when(code == 429, "RATE_LIMIT").when(code == 400, "BAD_REQUEST").when(code >= 500, "SERVER_ERROR").otherwise(F.concat(F.lit("HTTP_"), code.cast("string")))


def completions_url(url: Column, path: str = "/chat/completions") -> Column:
    """A service's address with the path of its call, if it has none; the query stays behind it."""
    own = F.trim(url)
    query = F.regexp_extract(own, r"(?s)(\?.*)$", 1)
    base = F.regexp_extract(own, r"(?s)^([^?]*)", 1)
    done = base.endswith("/completions") | base.endswith("/messages")
    return F.when(F.coalesce(own, F.lit("")) == "", url).when(done, own).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit(path), query))


def two_hashes(data: Column) -> Column:
    """Two 32-bit hashes of a text's bytes in one fold, sixteen hexadecimal digits."""
    low = F.lit((1 << 32) - 1)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(F.hex(data.cast("binary")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))

    def step(acc, b):
        one = _product32(acc["a"].bitwiseXOR(b), acc["b"])
        return F.struct(one.alias("a"), _product32(acc["b"].bitwiseXOR(b), F.lit(0x01000193).cast("long")).alias("b"))

    start = F.struct(F.lit(0x811C9DC5).cast("long").alias("a"), F.lit(0x01000193).cast("long").alias("b"))
    digits = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(low))), 8, "0")
    return F.when(F.length(data) == 0, F.concat(digits(F.lit(0x811C9DC5).cast("long")), digits(F.lit(0x01000193).cast("long")))).otherwise(F.aggregate(codes, start, step, lambda x: F.concat(digits(x["a"]), digits(x["b"]))))


def _product32(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of two 32-bit numbers, by halves, so that no product leaves 64 bits."""
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit((1 << 32) - 1))
    return (F.shiftleft(high, 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit((1 << 32) - 1))
