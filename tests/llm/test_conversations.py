"""Repair of conversations against a search over all edits, whole and cut into short segments."""

import functools
import hashlib
import random
import zlib

import pytest

from cinderlens.llm import conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FITS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for c, t, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def repaired(rows):
    """``rows``: role, text in order. Cost, audit and the repaired lines."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r").lstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, s, inserts=2):
        found = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
        add = lambda price, move, rest, line: found.append((price + rest[0], move + rest[1], line + rest[2]))
        if inserts:
            to, name = FITS[s]
            add(2, "I", best(i, to, inserts - 1), (f"{name}:",))
        if i < len(rows):
            role, text = rows[i]
            add(3, "D", best(i + 1, s), ())
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if (s, role[:1]) in NEXT:
                    add(cut, "K", best(i + 1, NEXT[s, role[:1]]), (f"{role}:{text}",))
                to, name = FITS[s]
                add(2 + cut, "R", best(i + 1, to), (f"{name}:{text}",))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):
        for s in range(4):
            best(i, s)
    return best(0, 0), faults


def expected(rows):
    out = []
    after = list(damage(rows))
    for c in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in after if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own} - {None}
        (cost, audit, lines), faults = repaired([r[2:] for r in own])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs):
    rng = random.Random(seed)
    texts = ["A.", "b", "Is it?", " ", "", None, "So!\n", "x. y", "long " * 50 + "end.", "né.", "　", "b\x85"]
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            rows.append((c, t + (t > 5) * 3, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice('.!?x')}"))
    return rows


def result(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in conversations.damage_report(frame, **more).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    out = made(1, range(150))
    # no turns, equal rows, rows of one turn, all rows of a conversation gone, a null conversation
    out += [(500, None, "user", "a."), (500, None, "assistant", "b."), (501, 1, "user", "Hi."), (501, 1, "user", "Hi."), (501, 1, "assistant", "Ho."), (501, 4, "system", "No.")]
    gone = next(i for i in range(600, 900) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out += [(gone, 0, "user", "a."), (None, 0, "user", "Yes."), (None, 1, "assistant", "No."), (None, None, None, None)]
    return out


@pytest.mark.parametrize("most", [512, 5, 1])
def test_against_all_edits(spark, rows, most):
    assert result(spark, rows, most=most) == expected(rows)


def test_sql_agrees(spark, rows, tmp_path):
    import duckdb

    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    assert sorted(con.execute(conversations.ORACLE_SQL).fetchall(), key=str) == expected(rows)


def test_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{t if t % 3 else 0}{rng.choice('.x')}") for t in range(2500)]
    assert result(spark, rows, most=64) == expected(rows)


def test_repaired_rows(spark, rows):
    after = spark.createDataFrame(rows, SCHEMA)
    got = conversations.repaired(conversations.damaged(conversations.plain_rows(after))).collect()
    lines = {}
    for r in sorted(got, key=lambda r: (r["conv"], r["place"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    hashes = {("" if r[0] is None else str(r[0])): r[-1] for r in expected(rows)}
    empty = hashlib.sha256(b"").hexdigest()
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: h for c, h in hashes.items() if h != empty}


def test_nodes_are_shared(spark):
    pairs = [("", "uaua"), ("", "uaua"), ("", "aua"), ("", "XuA"), ("0,4,2,0", "uaua")]
    got = {(r["end"], r["signature"]): r for r in conversations.automaton(spark.createDataFrame(pairs, "end string, signature string")).collect()}
    assert len(got) == 4
    assert [(got["", x]["costs"][0], got["", x]["audits"][0]) for x in ("uaua", "aua", "XuA")] == [(0, "KKKK"), (2, "IKKK"), (4, "DKK")]


def test_empty_and_clashing_columns(spark):
    assert conversations.damage_report(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(1, 1, "user", "a.", 1, 2, "x")], SCHEMA + ", conv long, at int, audits string")
    assert conversations.damage_report(frame).count() == 1
