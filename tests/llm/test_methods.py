"""What the methods themselves give, against brute force: link scores, bands, fingerprints, inclusion shares, blocks."""

import collections
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from conftest_rows import DOC_SCHEMA, document_rows

from cinderlens.llm import kneser_ney, licenses, mixing, order_minhash, quality, url_trust

# ---- link scores


def brute_ranks(links, t0, d0, rounds=400, damping=0.85):
    hosts = sorted({h for a, b, _ in links for h in (a, b)} | set(t0) | set(d0))
    out = collections.Counter()
    for a, _, n in links:
        out[a] += n
    t, r, d = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 1.0), dict.fromkeys(hosts, 0.0)
    for _ in range(rounds):
        gt, gr, gd = collections.Counter(), collections.Counter(), collections.Counter()
        for a, b, n in links:
            gt[b] += t[a] * n / out[a]
            gr[b] += r[a] * n / out[a]
            gd[a] += d[b] * n / out[a]
        t, r, d = (
            {h: (1 - damping) * t0.get(h, 0) + damping * (gt[h] + (0 if out[h] else t[h])) for h in hosts},
            {h: (1 - damping) + damping * (gr[h] + (0 if out[h] else r[h])) for h in hosts},
            {h: (1 - damping) * d0.get(h, 0) + damping * (gd[h] + (0 if out[h] else d[h])) for h in hosts},
        )
    return {h: (max(t0.get(h, 0), t[h] / r[h]), max(d0.get(h, 0), d[h])) for h in hosts}


def test_link_scores(spark):
    rng = random.Random(2)
    hosts = [f"h{k}" for k in range(12)]
    links = [(a, b, rng.randrange(1, 5)) for a in hosts[:9] for b in rng.sample(hosts, 3) if a != b]
    seeds = {h: (rng.choice([0, 0, 0.5, 1]), rng.choice([0, 0, 1])) for h in hosts[4:]}
    got = url_trust.propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame([(h, float(t), float(d)) for h, (t, d) in seeds.items()], "host string, trust double, distrust double"), tolerance=1e-7).collect()
    expected = brute_ranks(links, {h: t for h, (t, _) in seeds.items()}, {h: d for h, (_, d) in seeds.items()})
    assert {r["host"] for r in got} == set(expected)
    for r in got:
        assert math.isclose(r["trust"], expected[r["host"]][0], abs_tol=1e-5) and math.isclose(r["distrust"], expected[r["host"]][1], abs_tol=1e-5)


@pytest.mark.parametrize("size", [2, 60])
def test_every_host_of_a_farm_is_blocked(spark, size):
    to = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [(k, f"http://farm{k}.test/", to("bad.net")) for k in range(size)]
    pages += [(1000, "http://bad.net/", ""), (1001, "http://good.example.net/en/", to("fine.test")), (1002, "http://fine.test/", to("other.test")), (1003, "http://other.test/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_trust.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{k: "block" for k in range(size)}, 1000: "block", 1001: "allow", 1002: "allow", 1003: "allow"}


# ---- quality


def brute_kneser_ney(words, order):
    """log10 probability of a word, from the n-grams of all words."""
    grams = collections.Counter(tuple((b" " * (order - 1) + w + b"\n")[i : i + order]) for w in words for i in range(len(w) + 1))
    tables = [grams]
    for _ in range(order - 1):
        tables.insert(0, collections.Counter(g[1:] for g in tables[0]))
    levels = []
    for table in tables:
        d = kneser_ney.discounts(np.array(sorted(table.values())))
        total, off = collections.Counter(), collections.Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        levels.append((table, d, total, off))

    def p(g):
        if not g:
            return 1 / 256
        table, d, total, off = levels[len(g) - 1]
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        c = table[g]
        return (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * lower

    return lambda w: sum(math.log10(p(tuple((b" " * (order - 1) + w + b"\n")[i : i + order]))) for i in range(len(w) + 1))


def test_perplexities_and_bands(spark, results):
    texts = [(r[0], (r[1] or "").encode().split(), r[2]) for r in document_rows()]
    score = brute_kneser_ney([w for _, own, _ in texts for w in own], 5)
    known = {}
    ppl = [(i, len(own), lang, -sum(known.setdefault(w, score(w)) for w in own) / len(own) if own else None) for i, own, lang in texts]
    got = collections.defaultdict(list)
    for r in results("op3_quality_rules"):
        got[r["doc_id"]].append(r)
    quartile = lambda bins, k: min(b for b in bins if sum(n for x, n in bins.items() if x <= b) * 4 >= sum(bins.values()) * k) / 100
    medians, deviations = {}, collections.defaultdict(collections.Counter)
    for lang in {x[2] for x in ppl}:
        bins = collections.Counter(math.floor(x[3] * 100) for x in ppl if x[2] == lang and x[1] >= 10)
        medians[lang] = quartile(bins, 2) if bins else None
    deviation = lambda x: (x[3] - medians[x[2]]) / math.sqrt(1 / x[1] + 1 / quality.SAME)
    for x in ppl:
        if x[1] >= 10:
            deviations[x[2]][math.floor(deviation(x) * 100)] += 1
    every = sum(deviations.values(), collections.Counter())
    for x in ppl:
        for r in got[x[0]]:
            if x[3] is None:
                assert r["log10_ppl"] is None and not r["kept"]
                continue
            assert math.isclose(r["log10_ppl"], x[3], rel_tol=1e-9)
            if r["base_failed"]:
                assert not r["kept"]
                continue
            n = sum(deviations[x[2]].values())
            q1, q3 = ((quartile(deviations[x[2]], k) * n + quartile(every, k) * quality.POOLED) / (n + quality.POOLED) for k in (1, 3))
            q3 += 0.01
            low, high = q1 - quality.WIDTH * (q3 - q1), q3 + quality.WIDTH * (q3 - q1)
            # floors of hundredths may fall on either side of equal numbers
            if min(abs(deviation(x) - low), abs(deviation(x) - high)) > 0.02:
                assert r["kept"] == (low <= deviation(x) <= high)


def prose(rng, n):
    syllables = "the and of er an in th on re ed nd ha to ou ea en ti at".split()
    return " ".join(rng.choice(["the", "and", "of", "in", "a"]) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_spoiled_texts_are_rejected_and_others_kept(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randrange(80, 300)), "en") for k in range(300)]
    spoil = [lambda t: " ".join(w + "%%%" for w in t.split()), lambda t: " ".join(w.upper() + "!!" for w in t.split()), lambda t: " | ".join(t.split())]
    rows += [(1000 + k, spoil[k % 3](prose(rng, 200)), "en") for k in range(12)] + [(2000, prose(rng, 100), "xx")]
    kept = {r["doc_id"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert len(kept & set(range(300))) >= 294 and 2000 in kept
    assert not kept & set(range(1000, 1012))


def test_rows_without_an_id_are_judged_on_their_own(spark):
    rng = random.Random(8)
    good = prose(rng, 120)
    rows = [(None, good, "en", "a"), (None, "too short", "en", "b"), (5, good + " more", "en", "c"), (5, "", "en", "d")]
    assert sorted(r["key"] for r in quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")).collect()) == ["a", "c"]


# ---- fingerprints


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*parts):
    """Spark's xxhash64 of strings and 64-bit numbers."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<q", p) if isinstance(p, int) else p
        seed = xxhash.xxh64_intdigest(data, seed)
    return _signed(seed)


def brute_fingerprint(text, k=3, tuple_len=2, bits=6):
    mask = (1 << 26) - 1
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return ""
    runs = [words[i : i + k] for i in range(max(1, len(words) - k + 1))]
    seen, placed = collections.Counter(), []
    for at, run in enumerate(runs):
        first = hashed(*run) >> 26
        seen[first] += 1
        value = first if seen[first] == 1 else hashed(first, struct.pack("<i", seen[first] - 1)) >> 26
        placed.append((value << 26 | at % mask) if value >= 0 else -((-value) << 26) | at % mask)
    placed.sort()
    out = []
    for j in range(1 << bits):
        start = _signed(j << (64 - bits) & (1 << 64) - 1) | mask
        out.append((start, sum(x < start for x in placed)))
    values = []
    for j, (_, at) in enumerate(sorted(out)):
        own = [placed[(at + r) % len(placed)] for r in range(min(tuple_len, len(placed)))]
        ordered = sorted(_signed((x & mask) << 38 | (x & (1 << 64) - 1) >> 26) for x in own)
        seed = 42
        for x in ordered:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x & (1 << 38) - 1), seed)
        values.append(j << (32 - bits) | seed >> (32 + bits))
    return "".join(f"{v:08X}" for v in values)


def test_fingerprints_are_those_of_the_definition(results):
    order = sorted({(r[0], r[1] or "") for r in document_rows()}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {r["doc_id"]: r for r in results("op4_document_fingerprints")}
    share = lambda a, b: 1.0 if not a and not b else sum(a[i : i + 8] == b[i : i + 8] for i in range(0, min(len(a), len(b)), 8)) / (max(len(a), len(b)) // 8)
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        own, changed, after = brute_fingerprint(text), brute_fingerprint(text[: len(text) - half] + other[:half]), brute_fingerprint(other)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, changed), i
        assert math.isclose(got[i]["near_edited"], share(own, changed)) and math.isclose(got[i]["near_next"], share(own, after))


def test_order_counts_in_short_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[30:] + words[:30])), (3, " ".join(words[:30] + ["x"] + words[31:]))]
    df = order_minhash.with_fingerprint(spark.createDataFrame(rows, "id int, text string"), "text", "f")
    f = {r["id"]: set(r["f"]) for r in df.collect()}
    assert len(f[1] & f[2]) / 64 < 0.65 < len(f[1] & f[3]) / 64


# ---- mixing


def test_inclusion_shares(spark):
    rows = [(k, " ".join(["w"] * (4 if k % 3 else 36)), "s") for k in range(6000)] + [(9000, "w " * 5000, "s")]
    rows += [(10_000 + k, "w w", "t") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.4, seed=11).collect()
    for source in ("s", "t"):
        own = [r for r in got if r["source"] == source]
        target, whole = own[0]["target"], own[0]["target"] // own[0]["source_size"]
        assert math.isclose(sum(r["chance"] * r["size"] for r in own), target - whole * own[0]["source_size"], rel_tol=1e-6)
        assert abs(sum(r["taken"] for r in own) - target) <= 36
        for size in {r["size"] for r in own}:
            group = [r for r in own if r["size"] == size]
            drawn, chance = sum(r["copies"] for r in group) / len(group) - whole, group[0]["chance"]
            assert abs(drawn - chance) <= 4 * math.sqrt(max(chance * (1 - chance), 1e-4) / len(group)) + 0.01
    small, large = (next(r["chance"] for r in got if r["source"] == "s" and r["size"] == n) for n in (4, 36))
    assert math.isclose(large / small, 3, rel_tol=1e-6) or large == 1


def test_rows_are_taken_as_often_as_the_mix_says(spark):
    docs = spark.createDataFrame(document_rows(), DOC_SCHEMA)
    wanted = collections.Counter()
    for r in mixing.mix(docs).collect():
        wanted[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    taken = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in mixing.take(docs).collect())
    assert taken == +wanted


# ---- licenses


def test_labels_are_those_of_all_blocks(spark):
    rng = random.Random(9)
    notices = [t for own in licenses.TEMPLATES.values() for t in own]
    rows = []
    for k in range(60):
        parts = [" ".join(rng.choice("alpha beta the of and to license".split()) for _ in range(rng.randrange(0, 90))) for _ in range(3)]
        notice = rng.choice(notices).split()
        if k % 3 == 0:
            notice = [w for w in notice if rng.random() > 0.08]
        parts.insert(1, "\n".join(" ".join(notice[i : i + 6]) for i in range(0, len(notice), 6)))
        rows.append((k, "\n\n".join(parts)))
    sets = licenses.template_sets(licenses.TEMPLATES)
    got = {r["doc_id"]: {(m["label"], m["start"], round(m["score"], 9)) for m in r["matches"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    longest = max(len(licenses.normalised(t.encode()).split()) for t in notices)
    for k, text in rows:
        words = licenses.normalised(text.encode()).split()
        expected = set()
        for a, b in licenses.blocks_of(words, max(licenses.BLOCK_WORDS, 2 * longest)):
            own = set(words[a:b])
            expected |= {(label, a, round(len(t & own) / len(t), 9)) for label, t in sets if len(t & own) >= licenses.THRESHOLD * len(t) - 1e-9}
        assert got[k] == expected


def test_scores_do_not_depend_on_what_is_held_in_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a bb a ccc", "en"), (2, "bb dd dd " + "x" * 300, "en"), (2, "bb dd dd " + "x" * 300, "en"), (3, None, None), (4, "a", "fr")], "doc_id long, text string, lang string")
    rows = {}
    for held in (1000, 5, 1):
        monkeypatch.setattr(quality, "HELD", held)
        rows[held] = sorted(map(repr, quality.score_texts(docs).collect()))
    assert len(rows[1]) == 5 and rows[1000] == rows[5] == rows[1]
