"""Repair of conversations by a suffix-shared automaton over role/fault signatures.

A row of a conversation becomes one symbol: the initial of its role and whether its text is cut off, or that it must go
(blank, or said before). The symbols in order are the conversation's signature. A repaired conversation has the initials
``(s?(ua)+)?``: four grammar states (start, after s, after u, after a). Edits keep a row, give it the role that fits, delete
it, or insert an empty row; a grammar state and an edit's initial determine the next state, so of the cheapest edits the
ASCII-least string is found by taking the least initial among the cheapest moves at each place.

Cost-to-go and the best audit suffix only depend on what is left of the signature, so signatures share them from the end:
all distinct signatures are sorted by their reversed text, over all conversations and dealt by ranges, which is a walk over
the automaton of all suffixes in which what two neighbours share is still on the stack. Each node (a suffix) is worked out
once for each of the four states.

A conversation of any length is spread over many tasks: rows are sorted by ranges of (conversation, turn) and cut into
segments of at most ``SEGMENT`` symbols. What follows a segment acts on it by the four costs of its end only, so segments
are nodes of the same automaton with these costs as their end; they come from a pass backwards over the cost matrices of
the segments, which is one short row for ``SEGMENT`` rows. The last pass writes the repaired rows in order and hashes them;
a conversation goes through one task there because a hash is a chain, but the task holds one batch of it at a time.

Defined results: null roles and texts are one space, a null conversation id is one conversation, null turns come first; rows
of one turn are in order of their roles and then of their texts' hashes; texts are told apart by 128-bit hashes; equal rows
of one turn count as often as they stand; roles that begin with s, u or a keep their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable

#: Symbols of a segment.
SEGMENT = 512
#: Costs of edits; a kept or rerolled row that is cut off costs one more.
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, and the one after the role that fits.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FITS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
GONE = "X"


# ---- the automaton


class Node:
    """Of a suffix and by grammar state: cost to go, the least of the cheapest audits, and the state at its end."""

    __slots__ = ("audits", "costs", "exits")

    def __init__(self, costs: list[int], audits: list[str], exits: list[int]):
        self.costs, self.audits, self.exits = costs, audits, exits


def _with_inserts(costs: list[int], audits: list[str], exits: list[int]) -> Node:
    """The node when rows may also be inserted before it. ``audits`` of the other moves begin with their initials."""
    best = costs[:]
    for _ in range(3):
        best = [min(c, INSERT + best[FITS[s]]) for s, c in enumerate(best)]
    out = Node(best, audits[:], exits[:])
    # of equally cheap moves that with the least initial: D, I, K, R
    chosen = [best[s] < FAR and INSERT + best[FITS[s]] == best[s] and not (costs[s] == best[s] and audits[s] < "I") for s in range(4)]
    for s in (s for s in range(4) if chosen[s]):
        at, audit = s, ""
        while chosen[at]:
            at, audit = FITS[at], audit + "I"
        out.audits[s], out.exits[s] = audit + audits[at], exits[at]
    return out


def end_of(code: str) -> Node:
    """The node of the empty suffix: a conversation's end ("") or the costs that follow a segment ("-": no way)."""
    if not code:
        return _with_inserts([0, FAR, FAR, 0], ["", "", "", ""], list(range(4)))
    return Node([FAR if x == "-" else int(x) for x in code.split(",")], [""] * 4, list(range(4)))


def code_of(costs: list[int]) -> str:
    least = min(costs)
    return ",".join("-" if c >= FAR else str(c - least) for c in costs)


def before(symbol: str, rest: Node) -> Node:
    """The node of a suffix from its first symbol and the node of what follows."""
    costs, audits, exits = [DELETE + c for c in rest.costs], ["D" + a for a in rest.audits], rest.exits[:]
    if symbol != GONE:
        initial, cut = symbol.lower(), CUT_OFF if symbol.isupper() else 0
        for s in range(4):
            for move, to, price in (("K", AFTER[s].get(initial), cut), ("R", FITS[s], cut + RENAME)):
                if to is not None and price + rest.costs[to] < costs[s]:
                    costs[s], audits[s], exits[s] = price + rest.costs[to], move + rest.audits[to], rest.exits[to]
    return _with_inserts([min(c, FAR) for c in costs], audits, exits)


_SOLVED = "end string, signature string, costs array<long>, spent array<long>, exits array<int>, audits array<string>"


def automaton(pairs: DataFrame) -> DataFrame:
    """Costs to go, what a segment itself costs, the state at its end, and audits, by the state before it, of all distinct
    ``end, signature``. Neighbours in the order of reversed signatures share the nodes of their common suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stack, done = None, [], ""
        for batch in batches:
            out = []
            for end, back in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if end != last:
                    last, stack, done = end, [end_of(end)], ""
                shared = 0
                while shared < min(len(done), len(back)) and done[shared] == back[shared]:
                    shared += 1
                del stack[shared + 1 :]
                for symbol in back[shared:]:
                    stack.append(before(symbol, stack[-1]))
                done, node, close = back, stack[-1], [0 if not end else c for c in stack[0].costs]
                spent = [c - close[e] for c, e in zip(node.costs, node.exits, strict=True)]
                out.append((end, back[::-1], node.costs, spent, node.exits, node.audits))
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["end", "signature", "costs", "spent", "exits", "audits"])

    rows = pairs.distinct().select("end", F.reverse("signature").alias("back"))
    return rows.repartitionByRange("end", "back").sortWithinPartitions("end", "back").mapInArrow(run, _SOLVED)


# ---- signatures


def _shown(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def signed(rows: DataFrame) -> DataFrame:
    """Distinct rows ``conv, turn, role, h1, h2`` of ``conv, turn, role, text, times`` with ``blank``, ``cut``, ``later``
    (said in an earlier turn) and ``times``."""
    by = ["conv", "turn", "role", "h1", "h2"]
    last = F.right(_shown(F.col("text")), F.lit(1))
    keys = rows.select("conv", "turn", "role", *_hashes(), (last == "").alias("blank"), (~F.contains(F.lit(STOPS), last)).alias("cut"), "times")
    keys = durable(keys.groupBy(by).agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("times").alias("times")), "keys")
    said = keys.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("since"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    both = keys.join(said.hint("merge"), ["conv", "role", "h1", "h2"], "left")
    return both.select(*by, "blank", "cut", (F.col("since").isNotNull() & ~F.col("turn").eqNullSafe(F.col("since.turn"))).alias("later"), "times")


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")


_SEGMENTS = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("sub", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("signature", pa.string()), ("blanks", pa.int64()), ("repeats", pa.int64()), ("cuts", pa.int64())])
_SEGMENTS_DDL = "conv string, at long, sub long, turn long, role string, h1 long, h2 long, signature string, blanks long, repeats long, cuts long"


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Signatures of at most ``most`` symbols from ``signed`` rows, in order of ``at, sub`` within a conversation, each with
    the key of its first row and its faults."""
    by = ["conv", "turn", "role", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                initial = row["role"][:1]
                symbol = initial if initial in ("s", "u", "a") else "o"
                own = "" if row["blank"] or row["later"] else symbol.upper() if row["cut"] else symbol
                left, sub = row["times"], 0
                while left:
                    if held is not None and (held["conv"] != row["conv"] or len(held["signature"]) >= most):
                        out.append(held)
                        held = None
                    if held is None:
                        held = {k: row[k] for k in ("conv", "at", *by)} | {"sub": sub, "signature": "", "blanks": 0, "repeats": 0, "cuts": 0}
                        sub += 1
                    first = own if left == row["times"] else ""
                    gone = min(left - len(first), most - len(held["signature"]) - len(first))
                    held["signature"] += first + GONE * gone
                    held["blanks" if row["blank"] else "repeats"] += gone
                    held["cuts"] += first.isupper()
                    left -= len(first) + gone
            if out:
                yield pa.RecordBatch.from_pylist(out, _SEGMENTS)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], _SEGMENTS)

    order = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return order.mapInArrow(run, _SEGMENTS_DDL)


def _ends(parts: DataFrame) -> DataFrame:
    """``at, sub, end`` of the segments of conversations with more than one: the costs that follow each."""
    several = parts.groupBy("conv").agg(F.count("*").alias("k")).where("k > 1").select("conv")
    own = durable(parts.select("conv", "at", "sub", "signature").join(several.hint("merge"), "conv"), "several")
    units = F.explode(F.array(*(F.lit(",".join("0" if t == s else "-" for s in range(4))) for t in range(4))))
    solved = automaton(own.select("signature").distinct().select(units.alias("end"), "signature"))
    # a row for each end: its place is where the 0 stands
    matrix = solved.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct(F.instr("end", "0").alias("place"), "costs"))).alias("m")).select("signature", F.col("m.costs").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, follow = None, None
        for batch in batches:
            ends = []
            for own, m in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != conv:
                    conv, follow = own, None
                ends.append("" if follow is None else code_of(follow))
                # what follows the last segment is the end of the conversation
                then = end_of("").costs if follow is None else follow
                follow = [min(m[t][s] + then[t] for t in range(4)) for s in range(4)]
                follow = [c - min(follow) for c in follow]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ends, pa.string())], ["at", "sub", "end"])

    rows = own.join(matrix.hint("merge"), "signature").select("conv", "at", "sub", "m").repartition("conv").sortWithinPartitions("conv", F.desc("at"), F.desc("sub"))
    return rows.mapInArrow(run, "at long, sub long, end string")


def solved_segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The segments of ``conv, turn, role, text, times`` with their costs, ends and audits by the state before each."""
    parts = durable(segments(durable(signed(rows), "signed"), most), "segments")
    follows = durable(_ends(parts), "ends")
    parts = durable(parts.join(follows.hint("merge"), ["at", "sub"], "left").withColumn("end", F.coalesce("end", F.lit(""))), "parts")
    solved = durable(automaton(parts.select("end", "signature")), "automaton")
    return parts.join(solved.hint("merge"), ["end", "signature"]).select("conv", "at", "sub", "turn", "role", "h1", "h2", "blanks", "repeats", "cuts", "spent", "exits", "audits")


# ---- repaired rows


class Report:
    """Figures of one conversation and the hash of its repaired rows."""

    def __init__(self, conv: str):
        self.conv, self.blanks, self.repeats, self.cuts, self.cost, self.illegal = conv, 0, 0, 0, 0, 0
        self.turns, self.low, self.high, self.initial = 0, None, None, None
        self.audits: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def seen(self, turn: int | None, initial: str, times: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + times - 1
        self.initial = initial

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blanks, self.repeats, self.cuts, self.illegal, self.cost, "".join(self.audits), self.hash.hexdigest()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Report, list[tuple[str, str]], bool]]:
    """The conversations of sorted rows: a conversation's figures so far, repaired rows to add, and whether it is over."""
    report, state, entry, letters, at = None, START, START, "", 0

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal state, at
        while at < len(letters) and letters[at] == "I":
            state, at = FITS[state], at + 1
            yield NAMES[state], ""

    for batch in batches:
        for r in batch.to_pylist():
            if report is None or r["conv"] != report.conv:
                if report is not None:
                    yield report, list(inserted()), True
                report, state, entry, letters, at = Report(r["conv"]), START, START, "", 0
            if r["audits"] is not None:
                letters, at = letters[at:] + r["audits"][entry], 0
                report.audits.append(r["audits"][entry])
                report.cost += r["spent"][entry]
                report.blanks, report.repeats, report.cuts = report.blanks + r["blanks"], report.repeats + r["repeats"], report.cuts + r["cuts"]
                entry = r["exits"][entry]
            elif r["text"] is not None:
                report.seen(r["turn"], r["role"][:1], r["times"])
                for _ in range(r["times"]):
                    new = list(inserted())
                    move, at = letters[at], at + 1
                    if move == "K":
                        state = AFTER[state][r["role"][:1]]
                        new.append((r["role"], r["text"]))
                    elif move == "R":
                        state = FITS[state]
                        new.append((NAMES[state], r["text"]))
                    if new:
                        yield report, new, False
    if report is not None:
        yield report, list(inserted()), True


def _in_order(convs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """All conversations, their segments' audits and their rows, in order of conversation and turn; a segment comes before
    its first row."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = durable(solved_segments(rows, most), "solved")
    names = ["conv", "other", "turn", "role", "h1", "h2", "is_row", "at", "sub", "blanks", "repeats", "cuts", "spent", "exits", "audits", "text", "times"]
    figures = [none("long").alias(c) for c in ("blanks", "repeats", "cuts")] + [none("array<long>").alias("spent"), none("array<int>").alias("exits"), none("array<string>").alias("audits")]
    texts = rows.select("conv", F.lit(1).alias("other"), "turn", "role", *_hashes(), F.lit(1).alias("is_row"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sub"), *figures, "text", F.col("times").cast("int").alias("times"))
    parts = parts.select("*", F.lit(1).alias("other"), F.lit(0).alias("is_row"), none("string").alias("text"), none("int").alias("times")).select(names)
    marks = convs.select("conv", F.lit(0).alias("other"), none("long").alias("turn"), none("string").alias("role"), none("long").alias("h1"), none("long").alias("h2"), F.lit(0).alias("is_row"), none("long").alias("at"), none("long").alias("sub"), *figures, none("string").alias("text"), none("int").alias("times"))
    every = marks.unionByName(parts).unionByName(texts.select(names))
    return every.repartition("conv").sortWithinPartitions("conv", "other", "turn", "role", "h1", "h2", "is_row", "at", "sub")


def repair_report(convs: DataFrame, rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """``conv`` (of ``convs``), ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for report, new, over in _walk(batches):
            for role, text in new:
                report.add(role, text)
            if over:
                out.append(report.row())
            if len(out) == 1000 or over and len(report.audits) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ddl = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    return _in_order(convs, rows, most).mapInArrow(run, ddl)


def repaired(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The repaired conversations: ``conv, place, role, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for report, new, over in _walk(batches):
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([report.conv] * len(new)), pa.array(range(place, place + len(new)), pa.int64()), pa.array([r for r, _ in new]), pa.array([t for _, t in new])], ["conv", "place", "role", "text"])
            place = 0 if over else place + len(new)

    return _in_order(rows.select("conv").distinct(), rows, most).mapInArrow(run, "conv string, place long, role string, text string")


def plain_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, times`` with one space for nulls."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv"), F.col(turn_col).cast("long").alias("turn"), or_space(role_col).alias("role"), or_space(text_col).alias("text"), F.lit(1).alias("times"))


def damaged(rows: DataFrame) -> DataFrame:
    """``plain_rows`` as they are after damage by the crc32 of conversation and turn: 0 of 20 rows go, 1 lose their text, 2
    their stops, 3 stand twice, 4 are the user's."""
    key = F.concat(F.when(F.col("conv") == "", " ").otherwise(F.col("conv")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.where(kind != 0).select("conv", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))


def damage_report(conversations: DataFrame, most: int = SEGMENT) -> DataFrame:
    """What repair finds and does in each conversation after damage."""
    rows = plain_rows(conversations)
    kind = dict(conversations.dtypes)["conv_id"]
    out = repair_report(rows.select("conv").distinct(), damaged(rows), most)
    return out.withColumn("conv_id", F.when(F.col("conv") != "", F.col("conv")).cast(kind)).select("conv_id", *out.columns[1:])


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_BLANK_CLASS = r"[ \t\n\x0b\x0c\r]"
_SAME = "IS NOT DISTINCT FROM"
#: States count from 1 here: start, after s, after u, after a.
ORACLE_SQL = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
 d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE k <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS ini FROM d),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, CASE WHEN NOT regexp_matches(text, '{_BLANK_CLASS.replace("[", "[^", 1)}') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?]{_BLANK_CLASS}*$') THEN 't' ELSE 'k' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
 dp(conv_id, i, v) AS (SELECT conv_id, n + 1, [{{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM f WHERE i = n
  UNION ALL SELECT p.conv_id, f.i, list_transform([list_transform([1, 2, 3, 4], lambda s: list_sort(list_filter([
    {{'c': 3 + v[s].c, 'a': 'D' || v[s].a}},
    CASE WHEN fault IN ('t', 'k') AND (ini = 's' AND s = 1 OR ini = 'u' AND s <> 3 OR ini = 'a' AND s = 3) THEN {{'c': CASE fault WHEN 't' THEN 1 ELSE 0 END + v[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c, 'a': 'K' || v[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a}} END,
    CASE WHEN fault IN ('t', 'k') THEN {{'c': CASE fault WHEN 't' THEN 3 ELSE 2 END + v[CASE s WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'R' || v[CASE s WHEN 3 THEN 4 ELSE 3 END].a}} END], lambda x: x IS NOT NULL))[1])],
   lambda b: list_transform([1, 2, 3, 4], lambda s: list_sort([b[s], {{'c': 2 + b[CASE s WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'I' || b[CASE s WHEN 3 THEN 4 ELSE 3 END].a}}, {{'c': 4 + b[CASE s WHEN 3 THEN 3 ELSE 4 END].c, 'a': 'II' || b[CASE s WHEN 3 THEN 3 ELSE 4 END].a}}])[1]))[1]
  FROM dp p JOIN f ON f.conv_id {_SAME} p.conv_id AND f.i = p.i - 1),
 best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM dp WHERE i = 1),
 walk(conv_id, audit, place, i, s, acc) AS (SELECT conv_id, audit, 1, 1, 1, CAST(NULL AS VARCHAR) FROM best
  UNION ALL SELECT w.conv_id, audit, place + 1, CASE audit[place] WHEN 'I' THEN w.i ELSE w.i + 1 END, CASE WHEN audit[place] = 'D' THEN s WHEN audit[place] = 'K' THEN CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END WHEN s = 3 THEN 4 ELSE 3 END,
   CASE audit[place] WHEN 'D' THEN acc WHEN 'K' THEN concat_ws(chr(10), acc, role || ':' || text) ELSE concat_ws(chr(10), acc, CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE audit[place] WHEN 'R' THEN text ELSE '' END) END
  FROM walk w LEFT JOIN f ON f.conv_id {_SAME} w.conv_id AND f.i = w.i WHERE place <= length(audit)),
 made AS (SELECT conv_id, sha256(coalesce(acc, '')) AS h FROM walk WHERE place = length(audit) + 1),
 s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
 SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id {_SAME} a.conv_id LEFT JOIN best b ON b.conv_id {_SAME} a.conv_id LEFT JOIN made m ON m.conv_id {_SAME} a.conv_id"""
