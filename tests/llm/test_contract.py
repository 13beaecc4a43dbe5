"""Every query against brute force over the small tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
from conftest_rows import document_rows, page_rows, turn_rows

from cinderlens.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [(r[0], r[1] or "", r[3]) for r in document_rows()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


@pytest.mark.parametrize("name", list(QUERIES))
def test_a_row_for_each_row(results, name):
    rows = {"op1": page_rows(), "op8": page_rows(), "op11": {r[0] for r in turn_rows()}}.get(name.partition("_")[0], DOCS)
    assert len(results(name)) == len(rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_table(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0


def test_url_rules(results):
    got = by_id(results("op1_url_filters"), "page_id")
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block")
    assert (got[3]["rule"], got[4]["rule"], got[4]["verdict"]) == ("example.com/de/", "org/fr/", "allow")
    assert (got[7]["host"], got[8]["host"], got[9]["host"], got[10]["rule"]) == ("", "", "fine2.test", None)
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}


def test_license_phrases(results):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = collections.defaultdict(list)
    for r in results("op2_license_scans"):
        got[r["doc_id"]].append(r)
    for i, text, _ in DOCS:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split())
        for r in got[i]:
            assert (r["n_words"], r["n_base"]) == (len(own), len(at))
            assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1


def test_quality_statistics(results):
    got = by_id(results("op3_quality_rules"))
    for i, text, _ in DOCS:
        own = words(text)
        grams = collections.Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        repeated = {k + j for k in range(len(own) - 4) if grams[tuple(own[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"]) == (len(own), sum(map(len, own)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(own) < 10 or 100 * len(repeated) > 20 * len(own))
        assert not (r["base_failed"] and r["kept"])


def test_fingerprints(results):
    order = sorted({(i, t) for i, t, _ in DOCS}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = by_id(results("op4_document_fingerprints"))
    prints = {}
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["edited_fingerprint"] == r["fingerprint"]:
            assert r["near_edited"] == 1


def test_token_files(results):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    got = collections.defaultdict(list)
    for r in results("op5_token_output"):
        got[r["doc_id"]].append(r)
    for i in sorted(got, key=lambda x: (x is not None, x or 0)):
        text = next(t for j, t, _ in DOCS if j == i)
        ids = [*coder.encode(text, add_special_tokens=False).ids, 1]
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert (r["start"], r["n_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
            at += len(ids)


def test_base_scores(results):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*words(t.translate(LOWER)), None]
    counts = collections.Counter(w for i, t, _ in DOCS if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = by_id(results("op6_lm_scoring"))
    for i, text, _ in DOCS:
        own, r = tokens(text), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(w in counts for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_mix(results, spark, tables):
    rows = results("op7_source_mixing")
    size = collections.Counter()
    for _, text, source in DOCS:
        size[source] += len(words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(size.values())
    free = set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left, free = left - sum(2.0 * size[s] for s in full), free - full
    source_of, largest = {}, collections.Counter()
    for i, text, source in DOCS:
        source_of[i] = source
        largest[source] = max(largest[source], len(words(text)))
    taken = collections.Counter()
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = QUERIES["op7_source_mixing"](spark, tables).collect()
    assert sorted(map(str, (r.asDict() for r in again))) == sorted(map(str, rows))


def test_archives(results):
    rows = [(r[0], (r[2] or "").encode()) for r in page_rows()]
    holder = {}
    for i, body in rows:
        if len(body) >= 1000:
            holder[body] = max(i, holder.get(body, i))
    got = by_id(results("op8_warc"), "page_id")
    for i, body in rows:
        r, to = got[i], holder.get(body, i)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == i else ("revisit", to))
        assert r["n_requests"] == 1


def test_byte_bpe(results):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(results("op9_byte_bpe"))
    for i, text, _ in DOCS:
        ids = coder.encode_ordinary(text)
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def classes_of(rows, n, p, q):
    sets = {}
    for i, text in rows:
        own = words(text.translate(LOWER))
        sets[i] = {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))} if own else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and q * common >= p * (len(sets[a]) + len(sets[b]) - common) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_copies(results):
    expected = classes_of([(i, t) for i, t, _ in DOCS if i is not None], 3, 90, 100)
    for r in results("op10_ngram_jaccard_join"):
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]


def test_pipeline(spark, tables):
    import corpus_pipeline

    texts = {i: t for i, t, _ in DOCS}
    rows = corpus_pipeline.run(spark, tables).collect()
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert rows and max(ids.values()) <= 2
    classes = classes_of([(i, t) for i, t in texts.items() if i is not None], 5, 80, 100)
    kept = [classes[i][1] for i in ids if i is not None]
    assert len(kept) == len(set(kept))
    for r in rows:
        assert len(words(texts[r["doc_id"]])) >= 10
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
