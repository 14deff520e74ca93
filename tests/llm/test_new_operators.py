"""Spelling variants, periodic runs and phrase fingerprints against brute force, and on odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import html_text, periodic_runs, phrase_fingerprint, spelling_variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n int, form string, guest boolean, range int, t binary, tie string, h int"


def docs(spark, rows):
    """Rows (doc_id, text) with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", 1, "y", True, 3, b"z", "u", 5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def near_by_hand(words):
    """Pairs at distance one by masking: a word with a place starred or left out."""
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in near:
                near[w].add(x)
                near[x].add(w)
    masks = {}
    for w in words:
        for i in range(len(w)):
            masks.setdefault(w[:i] + "*" + w[i + 1 :], []).append(w)
    for same in masks.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    return near


def variants_by_hand(counts, ratio=10):
    near, form = near_by_hand(counts), {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def test_trie_walk():
    random.seed(11)
    words = sorted({"".join(random.choices("abé", k=random.randint(1, 7))).encode("latin-1") for _ in range(900)} | {b"a" * n for n in range(1, 40)})
    trie = spelling_variants.Trie.unpack(*spelling_variants.Trie.build(words, list(range(1, len(words) + 1))).pack())
    near = near_by_hand([w.decode("latin-1") for w in words])
    rank = {w: k for k, w in enumerate(words, 1)}
    for w in [*words, b"zz", b"abab" * 3]:
        got = list(trie.near(w))
        assert len(got) == len(set(got)) and all(rank[x] == n for n, x in got)
        if w in rank:
            assert {x.decode("latin-1") for _, x in got} == near[w.decode("latin-1")]
    long = b"ab" * 40_000
    assert list(spelling_variants.Trie.build([long, long + b"a"], [3, 9]).near(long)) == [(9, long + b"a")]


def test_spelling_variants(spark, real):
    rows = [(i, "Testing tested wordings") for i in range(200)] + [(1000 + i, "testong Testong") for i in range(5)] + [(3000, "tesong tesongs tesongs testongs testongs"), (3001, None), (3002, ""), (3003, "Éclairs éclairs éclairs × short")]
    rows += [(4000, "k" * 50_000 + " " + "k" * 50_000), (4001, "k" * 49_999 + "m " + "k" * 49_999 + "m"), (None, "nullids nullids")]
    counts = {r.word: r.n for r in spelling_variants.word_counts(docs(spark, rows)).collect()}
    assert counts["testing"] == 200 and counts["testong"] == 10 and counts["éclairs"] == 2 and "Éclairs" not in counts and counts["nullids"] == 2
    for options in ({}, {"shard_chars": 12, "pass_bytes": 200}):  # a shard a word or two, many passes
        got = spelling_variants.group_variants(spelling_variants.word_counts(docs(spark, rows)), **options)
        assert {tuple(r) for r in got.collect()} == variants_by_hand(counts)
    assert {r.word: r.root for r in got.collect()}["testong"] == "testing"
    # chains longer than one doubling
    chain = [("aaaaaaa" + "b" * i, 10**i) for i in range(9)]
    got = spelling_variants.group_variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r.root for r in got} == {"aaaaaaabbbbbbbb"} and {tuple(r) for r in got} == variants_by_hand(dict(chain))
    none = spelling_variants.group_variants(spelling_variants.word_counts(docs(spark, rows).limit(0)))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    by_hand = {}
    for r in real.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            by_hand[run] = by_hand.get(run, 0) + 1
    by_hand = {w: n for w, n in by_hand.items() if len(w) >= 7 and n >= 2}
    assert {tuple(r) for r in spelling_variants.op11_spelling_variants(spark, SF).collect()} == variants_by_hand(by_hand)


def runs_by_hand(w, least=24, times=3):
    """Every period over the whole text: stretches where words q apart agree, smallest periods only."""
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_find_runs():
    random.seed(12)
    texts = []
    for _ in range(150):
        text = [random.choice("abc") for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 4)):
            piece = [random.choice("abcd"[: random.randint(1, 4)]) for _ in range(random.randint(1, 15))]
            text += (piece * random.randint(2, 9))[: random.randint(1, 90)] + [random.choice("abcdef") for _ in range(random.randint(0, 12))]
        texts.append(text)
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts += [list("a" * 300), list(fib[-1]), list("ab" * 100 + "a" * 60 + "b" * 23 + "a" * 24), [], list("a" * 23), list("abcabcab" * 20), [str(i) for i in range(300)]]
    n = 0
    for text in texts:
        words = [x.encode() for x in text]
        for least, times in ((24, 3), (8, 2), (12, 4)):
            got = periodic_runs.find_runs(words, least, times)
            assert got == runs_by_hand(text, least, times)
            n += len(got)
        # what is left out of the automaton makes no difference
        assert sorted(periodic_runs.runs_in([words.index(x) for x in words], 24, 3), key=lambda r: (r[0], r[2])) == periodic_runs.find_runs(words)
    assert n > 300
    long = [b"w%d" % (i % 7_000) for i in range(70_000)] + [b"x"] * 50_000
    assert periodic_runs.find_runs(long) == [(0, 70_000, 7_000), (70_000, 50_000, 1)]


def test_periodic_runs(spark, real):
    rows = [(1, "a b " * 20 + "c"), (2, None), (3, ""), (3, ""), (None, "x y z " * 30), (7, "word " * 30_000), (8, " \t\n\x0b\x0c\r ")]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 40, 2)] and got[1].collapsed == "a b c" and got[2].runs == [] and got[2].collapsed == ""
    assert [tuple(x) for x in got[None].runs] == [(0, 30, 1)] and got[None].collapsed == "x y z" and got[7].collapsed == "word" and got[8].collapsed == ""
    assert periodic_runs.run_digests(docs(spark, rows)).count() == len(rows) and periodic_runs.run_digests(docs(spark, rows).limit(0)).count() == 0
    named = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.doc_id for r in periodic_runs.run_digests(named).collect()} == {None, "d1", "d2", "d3", "d7", "d8"}
    want = {}
    for r in real.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            w = [w[i] if i < a else w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
        runs = periodic_runs.find_runs([x.encode() for x in w]) if len(w) > 700 else runs_by_hand(w)
        best = min(runs, key=lambda x: (-np.float64(x[1]) / x[2], x[0], x[2]), default=None)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        told = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
        kept = " ".join(x for i, x in enumerate(w) if i not in gone).encode()
        want[r.doc_id] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert got == want and sum(x[0] for x in want.values()) > 10


def phrases_by_hand(text):
    seen, phrase = set(), b""
    for c in text.encode():
        phrase += bytes((c,))
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    return seen


def test_parse():
    random.seed(13)
    for _ in range(200):
        text = "".join(random.choices("abcé ", k=random.randint(0, 400)))
        phrases = phrase_fingerprint.parse(text.encode())
        assert set(phrases) == phrases_by_hand(text) and len(phrases) == len(set(phrases)) and text.encode().startswith(b"".join(phrases))
    a, b = phrases_by_hand("abc" * 20), phrases_by_hand("abd" * 20)
    assert phrase_fingerprint.share(phrase_fingerprint.smallest(list(a)), phrase_fingerprint.smallest(list(b))) == len(a & b) / len(a | b)
    big = [b"%d" % i for i in range(20_000)]
    got = phrase_fingerprint.share(phrase_fingerprint.smallest(big[:15_000]), phrase_fingerprint.smallest(big[5_000:]))
    assert abs(got - 0.5) < 0.15


def edited_by_hand(rows):
    """Sorted by id (null first), then in the order given for equal ids."""
    keep = lambda t: phrase_fingerprint.smallest(sorted(phrases_by_hand(t)))
    out = {}
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = keep(t), keep(edited), keep(after)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), phrase_fingerprint.encoded(a), phrase_fingerprint.encoded(b), phrase_fingerprint.share(a, b), phrase_fingerprint.share(a, c))
    return out


def test_fingerprints(spark, real):
    rows = [(None, "abc" * 30), (1, ""), (2, "x"), (3, "é😀" * 50), (4, "word " * 30_000), (6, "short"), (9, "same text, same print"), (10, "same text, same print")]
    for size in (1, 3, 100):
        got = {r.doc_id: tuple(r)[1:] for r in phrase_fingerprint.edited_likeness(docs(spark, rows), rows_per_range=size).collect()}
        assert got == edited_by_hand(rows)
    got = phrase_fingerprint.edited_likeness(docs(spark, [*rows[1:], (1, None), (1, "q"), (1, "q")]), rows_per_range=1).collect()
    assert len(got) == 10 and sorted(r.n_chars for r in got if r.doc_id == 1) == [0, 0, 1, 1]
    assert phrase_fingerprint.edited_likeness(docs(spark, rows).limit(0)).count() == 0
    (one,) = phrase_fingerprint.edited_likeness(docs(spark, [(5, "alone here")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone heal").hexdigest()
    named = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert phrase_fingerprint.edited_likeness(named, rows_per_range=2).count() == len(rows)
    prints = phrase_fingerprint.fingerprints(docs(spark, rows))
    same = prints.alias("a").join(prints.alias("b"), F.expr("a.doc_id = 9 AND b.doc_id = 10")).select(phrase_fingerprint.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")), F.expr("a.fingerprint = b.fingerprint")).first()
    assert tuple(same) == (1.0, True)
    want = edited_by_hand([(r.doc_id, r.text or "") for r in sorted(real.collect(), key=lambda r: r.doc_id)])
    got = {r.doc_id: tuple(r)[1:] for r in phrase_fingerprint.op13_phrase_fingerprint(spark, SF).collect()}
    assert got == want
    edited = np.mean([x[4] for x in want.values()])
    assert edited > 0.55 > 0.3 > np.mean([x[5] for x in want.values()])


def test_broken_pages_stay_linear():
    """A megabyte of broken markup of each kind within seconds; a quadratic parser needs an hour."""
    pages = ["<a href='x' " * 90_000, "<a '>' " * 140_000 + '"', "<div>" * 200_000, "<div>" * 100_000 + "</p></i></section>" * 50_000, "<nav>" + "<article>" * 100_000, "<li>a" * 200_000, "<a" * 500_000,
             "<div class=sidebar>" * 60_000 + "<article>" * 60_000]
    start = time.time()
    for html in pages:
        page = html_text.Page(html)
        page.text(set())
        page.templates()
    assert time.time() - start < 60


def test_what_is_no_article_text():
    text = lambda html: html_text.Page(html).text(set())
    assert text("<article>A<div class='cookie-notice'>We use cookies</div><div class=newsletter>Subscribe now</div><div class='share-buttons'>Share</div><p>B</p></article>") == "A\n\nB"
    assert text("<main><p>A</p></main><article>Teaser</article>") == "A" and text("<article>A</article><article>B</article>") == "A\n\nB"
    assert text("<p>one < two</p><p title='a>b'>three") == "one < two\n\nthree" and text("<p>a</i></section>b<p>c <a href=\"x>d") == "a\n\nb\n\nc d"
