"""Rows of the small tables."""

import random

WORDS = "alpha beta gamma delta omega river stone cloud maple tiger Paris école straße node data token graph licence free".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, tie string, label string, n int"
LABEL_SCHEMA = "doc_id long, quality int, toxic int"
TURN_SCHEMA = "conv_id long, turn long, role string, text string, conv int, at string"
PAGE_SCHEMA = "page_id long, url string, html string, id long, host string, key string, type string"


def document_rows():
    """Nulls in every column, empty, blank and very long texts, ties, exact and near copies, a repeated row."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(12, 60))) for _ in range(30)]
    base = " ".join(f"word{i}" for i in range(120))
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "a\nb\na\n\n\nb", "x y z w v x y z w v q"]
    texts += [base, base, base.replace("word60", "changed"), base.upper(), " ".join(f"w{i % 977}" for i in range(20_000))]
    texts += ["Released under the MIT License. It is cc by or CC BY.", "GNU General\nPublic License apache license", "İ, foo a <|endoftext|> b <|ENDOFTEXT|> Ǆ, x", "it's 12345, don't! … naïve Ünïcode 漢字 😀 <|endoftext|>"]
    rows = [(100 - i, t, None if i % 7 == 3 else ("en", "fr")[i % 2], None if i % 9 == 4 else ("web", "books", "Zed")[i % 3 if i % 4 else 0], None, 1, "k", "t", "l", i) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id at all", "en", "web", 1, None, None, None, None, None)]


def page_rows():
    body = "<p>" + "long page " * 120 + "</p>"
    pages = [("http://a.example.net/en/x?q=1", body), ("https://A.Example.NET/de/", body), ("http://example.com/de/1", f'<a href="http://b.org/fr/">x</a>{body}'), ("ftp://b.org/fr/page#top", "<p>é</p>"), ("http://fine.test", '<a href="http://spam.net/">a</a><a href=//fine2.test/>b</a>'), ("http://spam.net/", ""), (None, None), ("no scheme", body), ("http://fine2.test?x", "short"), ("http://notnet/", "x\r\n\r\ny"), ("http://notnet/2", "x\r\n\r\nWARC/1.1\r\ny\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n")]
    return [(i + 1, url, html, 1, "h", "k", "t") for i, (url, html) in enumerate(pages)]


def label_rows():
    return [(100 - i, (i // 3) % 2, 0) for i in range(40)] + [(None, 1, 0), (90, None, 0)]


def turn_rows():
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}.", 1, "x") for c in range(8) for t in range(c)]
    return [*rows, rows[0], (None, None, None, None, None, None), (3, None, "system", " ", 1, None)]
