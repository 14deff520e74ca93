"""The training-data operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import embedding_dedup, exact_dedup, html_text, jaccard_join, license_scan, mixing, quality, sentencepiece_dropout, token_counts, toxicity
from veilwork.llm.common import components, materialise

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot int, label string, words int, hit boolean"


def docs(spark, rows):
    """Rows (doc_id, text, source) with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 7, "y", 1, True) for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "b"), (3, "Same text here", "a"), (4, "Same text here", "a"), (4, "Same text here", "a"), (None, "Same text here", None), (5, "same text here", "b"), (6, "word " * 30_000, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, ODD).limit(0)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(odd, none):
    rows = exact_dedup.duplicate_groups(odd, digest_all=True).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[3].keep_id, by[3].group_size, by[3].kept) == (4, 4, False) and by[5].kept and by[6].kept
    assert sorted(r.kept for r in rows if r.doc_id == 4) == [False, True]  # of rows that repeat id and text one stays
    assert by[None].keep_id == 4 and not by[None].kept
    assert by[1].keep_id == 2 and by[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6].text_sha256 == hashlib.sha256(b"word " * 30_000).hexdigest()
    # without digest_all only rows that survive the prefix step are digested
    assert [r.text_sha256 for r in exact_dedup.duplicate_groups(odd).where("doc_id = 6").collect()] == [None]
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [2, 4, 5, 6]
    assert exact_dedup.duplicate_groups(none).count() == 0


def test_clashing_ids(spark):
    """Rows that repeat an id with another text are documents of their own in every step that drops or repeats rows."""
    words = [f"w{i}" for i in range(60)]
    long = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(3)]  # near copies
    df = docs(spark, [(5, "A text", "a"), (5, "B text", "a"), (9, "B text", "a"), (None, "C", "a"), (None, "C", "a"), (None, "D", "a"), (1, long[0], "a"), (1, long[1], "a"), (1, "A loner", "b"), (7, long[2], "b")])
    left = exact_dedup.drop_duplicates(df)
    assert sorted((r.doc_id or 0, r.text) for r in left.where(F.length("text") < 9).collect()) == [(0, "C"), (0, "D"), (1, "A loner"), (5, "A text"), (9, "B text")]
    near = sorted((r.doc_id or 0, r.text) for r in jaccard_join.one_per_group(df).collect())
    assert len(near) == 6 and sum(t in long for _, t in near) == 1 and (5, "A text") in near and (1, "A loner") in near and (5, "B text") in near and (9, "B text") not in near
    per = mixing.taken_words(df).collect()
    mixed = mixing.mixed_rows(df)
    assert len(per) == 10 and mixed.columns == df.columns
    times, got = {}, {}
    for r in per:
        n = r.taken // r.size
        times[r.doc_id, r.source, r.size] = times.get((r.doc_id, r.source, r.size), 0) + n
    for r in mixed.collect():
        k = (r.doc_id, r.source, len(r.text.split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in times.items() if n}


def test_same_prefix_and_length_differ(spark):
    a, b = "p" * 300 + "x", "p" * 300 + "y"
    got = exact_dedup.duplicate_groups(docs(spark, [(1, a, "s"), (2, b, "s"), (3, a, "s")])).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 3, 2: 2, 3: 3}


def test_mixing(spark, odd, none, real):
    rows = mixing.taken_words(real).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    largest = max(r.size for r in rows)
    assert all(abs(sum(r.taken for r in v) - v[0].target) <= largest for v in by.values())
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    again = mixing.taken_words(real.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    got = mixing.taken_words(odd).collect()
    assert len(got) == len(ODD) and all(r.taken in (0, r.size, 2 * r.size) for r in got) and sum(r.taken for r in got) <= 1.5 * sum(len((t or "").split()) for _, t, _ in ODD)
    assert mixing.taken_words(none).count() == 0
    assert [r.taken for r in mixing.taken_words(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_license_scan(spark, odd, none):
    text = "x CC-BY y all rights  reserved; All-Rights reserved. Released under the  old MIT License, GNU General Public License"
    rows = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, [(1, text, "a"), (2, None, "a"), (3, "cc", "a"), (4, "nothing at all", None)])).collect()}
    r = rows[1]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (4, 1, 17, "cc-by,gpl,reserved", "cc-by,gpl,mit,reserved", 1.0)  # the notice with a word put in covers 3 of 4 pairs
    assert (rows[2].n_words, rows[2].n_base, rows[2].first_word, rows[2].labels, rows[2].score) == (0, 0, None, "", 0.0)
    assert rows[3].n_words == 1
    near = license_scan.scan_licenses(docs(spark, [(1, "this work is licensed under the GNU general public license, any version 3", "a"), (2, "released into a very public domain", "a"), (3, "released into the very public domain", "a")])).collect()
    assert {x.doc_id: x.labels for x in near} == {1: "gpl", 2: "", 3: "public-domain"}
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(none).count() == 0


def test_license_scan_of_long_texts(spark):
    """Time in proportion to words: each pair goes on without the text's other words."""
    import time

    base = " ".join(f"w{i % 977}" for i in range(240_000))
    took = []
    for _ in range(2):
        start = time.time()
        r = license_scan.scan_licenses(docs(spark, [(1, base + " all rights reserved " + base, "a")])).collect()[0]
        took.append(time.time() - start)
    assert (r.n_words, r.first_word, r.n_base) == (480_003, 240_000, 1) and took[1] < 20
    body = "This program is free software: you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License, or (at your option) any later version."
    spans = license_scan.license_spans(docs(spark, [(1, "x y " + body, "a")]))[1].where("NOT exact").collect()
    assert [s.label for s in spans if s.start == 2 and s.stop >= 30] == ["gpl"] and all(s.coverage < 1 for s in spans if s.stop >= 30)


def _brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_brute_force(spark, k, percent):
    random.seed(k)
    rows = []
    for base in range(14):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice([4, 9, 12, 20, 40, 150, 600]))]
        for _ in range(random.randrange(1, 14)):
            copy = list(words)
            for _ in range(random.randrange(0, max(2, len(words) // 12))):
                copy[random.randrange(len(copy))] = f"n{random.randrange(10**6)}"
            rows.append(" ".join(copy[: random.choice([len(copy), len(copy), len(copy) - 1])]))
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, " \n ")]
    got = jaccard_join.similar_groups(docs(spark, [(i, t, "s") for i, t in rows]), shingle=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == _brute_groups(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_keys_at_the_limit(percent):
    """Sets that differ in as many shingles as linked ones can share a key, at every size and however the difference lies between the two."""
    rng, scheme = np.random.default_rng(5), jaccard_join.Cuts(percent)
    keys = lambda s: {k for m in scheme.marks(np.unique(s)) for k in m[2].tolist()}
    tried = 0
    for n in [*range(scheme.least, 60), 75, 90, 120, 180, 250, 326, 450, 700, 1300]:
        for share in np.linspace(0, 1, 9):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            gone = int(share * n * (100 - percent) / 100)
            new = (n - gone) * 100 // percent - n
            if new < 0 or gone + new == 0:
                continue
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            assert 100 * (n - gone) >= percent * (n + new) and keys(a) & keys(b)
            tried += 1
    assert tried > 300


def test_jaccard_shared_passages(spark):
    random.seed(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(3)]
    rows = []
    for base in range(40):
        own = [f"b{base}w{i}" for i in range(random.choice([10, 40, 200]))]
        for copy in range(random.randrange(1, 4)):
            rows.append(" ".join([random.choice(passages)] + own[copy:] + [f"e{copy}"]))
    rows += [passages[0] + " " + " ".join(f"v{i % 2}y{j}" for j in range(i % 9)) for i in range(60)] + passages
    rows = list(enumerate(rows))
    got = jaccard_join.similar_groups(docs(spark, [(i, t, "s") for i, t in rows]), shingle=5, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == _brute_groups(rows, 5, 80)


def test_jaccard_blocks_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(30)]
    got = jaccard_join.similar_groups(docs(spark, [(i, t, "s") for i, t in rows]), shingle=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == _brute_groups(rows, 3, 80)
    got = jaccard_join.similar_groups(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (3, 4, 5, None)} == {3}
    assert sorted(r.doc_id or 0 for r in jaccard_join.one_per_group(odd).collect()) == [1, 2, 3, 6]
    assert jaccard_join.similar_groups(none).count() == 0


def _around_hubs(seed, sets, words=60):
    """Texts around two hubs, from slightly to heavily changed, and texts that share a passage with a hub only."""
    rng, rows = random.Random(seed), []
    hubs = [[f"h{k}w{i}" for i in range(words)] for k in range(2)]
    for i in range(sets):
        text = list(hubs[i % 5 == 0])
        if i % 7 == 0:
            text[words // 3 :] = [f"o{i}x{j}" for j in range(words)]
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"n{rng.randrange(9)}" if i % 3 else f"n{i}z{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_jaccard_large_groups(spark, monkeypatch):
    """Large groups of a key made one and cut into blocks: every link is found."""
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    monkeypatch.setattr(jaccard_join, "KEY_BLOCK", 4)
    rows = _around_hubs(3, 170)
    got = jaccard_join.similar_groups(docs(spark, [(i, t, "s") for i, t in rows]), shingle=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == _brute_groups(rows, 3, 80)


def test_jaccard_rows_of_large_groups(spark, monkeypatch):
    """Near copies are not compared anew for every key that they share, and the rows that large groups are compared in do not grow with the square of their sets."""
    monkeypatch.setattr(jaccard_join, "FEW", 8)
    monkeypatch.setattr(jaccard_join, "KEY_BLOCK", 8)
    made, plainly = [], jaccard_join.near_edges
    monkeypatch.setattr(jaccard_join, "near_edges", lambda tagged, scheme: made.append(tagged.count()) or plainly(tagged, scheme))
    for sets in (150, 600):
        jaccard_join.similar_groups(docs(spark, [(i, t, "s") for i, t in _around_hubs(4, sets)]), shingle=3, percent=80).count()
    assert made[0] < 4_000 and made[1] < 40_000


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    near = x[:60] + rng.normal(size=(60, 16)) * 0.05
    x = np.vstack([x, near, x[:5], 3 * x[:5]])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = jaccard_join.roots(link)
    for sigmas in (None, 3.0):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, sigmas=sigmas, cell_size=20).collect()}
        assert all((got[i].n_links, got[i].component_id) == (link[i].sum(), root[i]) for i in range(len(x)))
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1005))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "rank", "dim", "axes"), [(2500, 5, 128, None), (3000, 64, 64, None), (3000, 64, 64, 1), (3000, 64, 64, 3)])
def test_embeddings_recall(spark, n, rank, dim, axes):
    """Thousands of planted pairs near the threshold, on vectors of low and of full rank, with offsets spread evenly or along the leading axes, over many cells: links are found and counted once."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, rank)) * (np.ones(rank) if axes is None else np.arange(1, rank + 1) ** -0.5)
    noise = rng.normal(size=x.shape)
    noise[:, axes or rank :] = 0
    noise *= (np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1) * rng.uniform(0.28, 0.33, n))[:, None]
    x = np.vstack([x, x + noise])
    x = np.hstack([x, np.zeros((len(x), dim - rank))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() > n
    root = jaccard_join.roots(link)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(10**6, [1.0, 2.0]), (10**6 + 1, [2.0, 4.1]), (10**6 + 2, [-1.0])]  # other lengths link among themselves
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, cell_size=60).collect()}
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.99 * link.sum() <= found <= link.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.99
    assert (got[10**6].n_links, got[10**6 + 1].component_id, got[10**6 + 2].n_links) == (1, 10**6, 0)
    if axes is None:
        exact = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, cell_size=60, sigmas=None).collect()}
        assert [(exact[i].n_links, exact[i].component_id) for i in range(len(x))] == list(zip(link.sum(1), root))
    print("recall", found / link.sum())


def test_embedding_reach():
    """Recall of planted links by visits alone, over 400 cells of 40,000 vectors: power spectrum, clusters and few axes."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    n, dim, apart = 20_000, 64, float(np.sqrt(0.1))
    spectrum = np.arange(1, dim + 1) ** -1.0
    centre = rng.normal(size=(300, dim))
    few = np.zeros(dim)
    few[:2] = 1
    shapes = {"spectrum": (rng.normal(size=(n, dim)) * spectrum, spectrum), "axes": (rng.normal(size=(n, dim)) * spectrum**0.5, few),
              "clusters": (centre[rng.integers(0, 300, n)] + rng.normal(size=(n, dim)) * 0.35, few)}
    for name, (x, shape) in shapes.items():
        x, d = unit(x), rng.normal(size=(n, dim)) * shape
        d = unit(d - (d * x).sum(1, keepdims=True) * x)
        t = rng.uniform(0.951, 0.965, n)[:, None]
        y = t * x + np.sqrt(1 - t * t) * d
        sample = np.vstack([x, y])[rng.permutation(2 * n)[:12_800]]
        c = embedding_dedup.fit_centres(sample, 400, 4)
        most = embedding_dedup.limits(sample, (x[:500], y[:500]), c, apart, 3.0)
        (hx, ix), (hy, iy) = embedding_dedup.visits(x, c, most), embedding_dedup.visits(y, c, most)
        found = (ix[np.arange(n), hy] | iy[np.arange(n), hx]).mean()
        print(name, found, ix.sum(1).mean())
        assert found >= 0.99


def test_embedding_blocks(spark, monkeypatch):
    """Cells cut into blocks count each pair once."""
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 16 * 8 * 6)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6))
    x = np.vstack([x, x + rng.normal(size=x.shape) * 0.1, x[:3]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, cell_size=40, sigmas=None).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == list(zip(link.sum(1), jaccard_join.roots(link)))


def _agenda(word, voc, limit, base):
    """Brute force: every turn looks at all neighbouring pairs anew."""
    part, skipped, turn = list(word), set(), 0
    while True:
        offers = [(voc.rank[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in voc.rank and i not in skipped]
        if not offers:
            return [i for p in part for i in ([voc.id[p]] if p in voc.id else voc.bytes_of(p))]
        turn += 1
        rank, i = min(offers)
        if sentencepiece_dropout.skips(base, turn, rank, limit):
            skipped.add(i)
            continue
        skipped = set()
        part[i : i + 2] = [part[i] + part[i + 1]]


def test_sentencepiece(spark, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    texts = ["", " ", "  two  spaces ", "\n", "a\nb", "\n\nx \n y", "one line\nand another. \nEnd\n", "línea\n\ttab 日本 😀 \x00", "a" * 500, "Plain words, and more words."]
    exact = sentencepiece_dropout.Encoder(drop=0.0)
    assert [exact.encode(t, 1).tolist() for t in texts] == [model.encode(t) for t in texts]
    voc = exact.voc
    for drop in (0.1, 0.6):
        ids = [sentencepiece_dropout.Encoder(drop=drop, seed=3).encode(t, 9) for t in texts]
        assert [sentencepiece_dropout.decode_ids(i, voc) for i in ids] == texts
        assert all((a == b).all() for a, b in zip(ids, [sentencepiece_dropout.Encoder(drop=drop, seed=3).encode(t, 9) for t in texts]))
    long = " ".join(f"inter{a}national{b}isation of re{b}token{a}isation" for a in ("trans", "over", "sub") for b in ("hyper", "ultra", "pseudo", "quasi"))
    assert len({tuple(sentencepiece_dropout.Encoder(drop=0.3, seed=s).encode(long, 1)) for s in range(5)}) == 5
    words = ["▁" + w for w in long.split()] + ["▁", "▁▁", "a", "▁日本", "▁x😀", "▁\x00"]
    for limit in (0, 2**29, 2**31):
        base = np.arange(len(words), dtype=np.uint64) * np.uint64(2**27 + 5) % np.uint64(2**32)
        many = sentencepiece_dropout.cut_many(words, voc, limit, base)
        assert [p[p >= 0].tolist() for p in many] == [sentencepiece_dropout.cut(w, voc, limit, int(b)) for w, b in zip(words, base)]
        assert [sentencepiece_dropout.cut(w, voc, limit, int(b)) for w, b in zip(words, base)] == [_agenda(w, voc, limit, int(b)) for w, b in zip(words, base)]
        word = "▁antidisestablishmentarianism"
        assert sentencepiece_dropout.merge_short(list(word), voc.rank, limit, 77) == sentencepiece_dropout.merge_long(list(word), voc.rank, limit, 77)
    marked = ["a▁b", "▁", " ▁▁ x▁ ", "日▁本"]
    assert [sentencepiece_dropout.decode_ids(exact.encode(t, 1), voc) for t in marked] == marked
    repeated = sentencepiece_dropout.encode_column(docs(spark, [(8, long, "a")] * 3)).collect()
    assert len(repeated) == 3 and len({tuple(r.tokens) for r in repeated}) == 1
    coded = sentencepiece_dropout.encode_column(odd)
    back = sentencepiece_dropout.decode_column(coded).collect()
    assert all(r.decoded == r.text for r in back) and len(back) == len(ODD)
    assert sentencepiece_dropout.encode_column(none).count() == 0


def test_sentencepiece_draws_per_occurrence():
    """One word in many documents and places gets many cuts, at the dropout's rate, and each is what cut() gives for its base."""
    encoder = sentencepiece_dropout.Encoder(drop=0.1, seed=3)
    text = " ".join(["internationalisation"] * 20)
    rows = encoder.encode_batch([text] * 50, range(50))
    assert len({tuple(r) for r in rows}) == 50
    limit, drawn = int(0.1 * 2**32), []
    for d, r in enumerate(rows):
        cuts = [_agenda("▁internationalisation", encoder.voc, limit, int(b)) for b in encoder.bases(d, 20)]
        assert sum(cuts, []) == r.tolist()
        drawn += map(tuple, cuts)
    assert len(set(drawn)) >= 6
    turns = int(encoder.cuts.turns.all[encoder.cuts.root["internationalisation"]])
    plain = tuple(sentencepiece_dropout.cut("▁internationalisation", encoder.voc, 0, 0))
    base = np.concatenate([encoder.bases(d, 20) for d in range(500)])
    node = encoder.cuts.find(["internationalisation"] * len(base), base)
    assert abs((node == encoder.cuts.root["internationalisation"]).mean() - 0.9**turns) < 0.02 and plain in drawn
    many = {tuple(x) for r in encoder.encode_batch(["internationalisation"] * 1000, range(1000)) for x in [r.tolist()]}
    assert len(many) >= 6  # one word in 1,000 documents
    mixed = ["a\nb  c", "naïve \U0001f600x " + "b" * 300 + " end\n\nx", "", None, "▁x y"] * 3
    for drop in (0.0, 0.3, 0.9):
        got = sentencepiece_dropout.Encoder(drop=drop, keep=5).encode_batch(mixed, range(15), chunk=5)
        one = sentencepiece_dropout.Encoder(drop=drop).encode_batch(mixed, range(15))
        assert all(a is b is None or a.tolist() == b.tolist() for a, b in zip(got, one))


def test_token_counts(odd, none, real):
    voc = token_counts.pieces(token_counts.MODEL).id
    machine = token_counts.Automaton(voc)

    def greedy(s):
        n = i = 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + 40), i, -1) if s[i:j] in voc), None)
            if j is None:
                return 0
            n, i = n + 1, j
        return n

    words = {w for r in real.select("text").limit(40).collect() for w in r.text.split()} | {"\U0001f600x", "ab\U0001f600", "naïveté"}
    assert all(machine.count("▁" + w) == greedy("▁" + w) for w in words)
    small = token_counts.Automaton(["▁a", "▁abcd", "b", "bc", "c", "cde", "d"])
    assert [small.count(w) for w in ("▁abcd", "▁abcde", "▁abcx", "▁abd", "▁x", "▁")] == [1, 0, 0, 3, 0, 0]
    rows = token_counts.count_tokens(odd).collect()
    assert [(r.n_words, r.n_tokens) for r in rows if r.doc_id == 1] == [(None, None)] and [r.n_tokens for r in rows if r.doc_id == 2] == [0]
    assert token_counts.count_tokens(none).count() == 0


def test_toxicity(spark, odd, none):
    big = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    r = toxicity.score_documents(documents, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).select("score", "toxic", F.size("sentences").alias("n")).toPandas()
    hit = r.score >= 0.5
    assert (hit == (r.toxic == 1)).mean() > 0.97 and (r.toxic[hit] == 1).mean() > 0.95
    got_text = "All is fine. You are an idiot and trash! Bye."
    got = toxicity.score_documents(docs(spark, [(1, got_text, "a"), (2, None, "a"), (3, "", "a")]), model).collect()
    assert [got_text[s.start : s.stop].strip() for s in got[0].sentences] == ["You are an idiot and trash!"] and got[0].score > 0.5 and got[1].score == got[2].score < 0.5
    assert toxicity.score_documents(odd, model).count() == len(ODD) and toxicity.score_documents(none, model).count() == 0
    empty = toxicity.train(odd, labels.limit(0))
    assert toxicity.score_documents(odd, empty).where("score <> 0").count() == 0


def test_noisy_or_and_labels(spark):
    w, bias, leak = np.array([1.5, -0.3, 2.0]), -1.0, 0.02
    model = ({"bad": 0, "meh": 1, "awful": 2}, w, bias, leak)
    text = "Bad meh day. Nothing here! An awful, awful\nbad thing?"
    plain = lambda *k: 1 / (1 + np.exp(-(bias + sum(w[i] for i in k))))
    r = toxicity.score_documents(docs(spark, [(1, text, "a"), (1, text, "a"), (2, "x", "b")]), model).collect()
    assert r[0].score == r[1].score == pytest.approx(1 - (1 - leak) * (1 - plain(0, 1)) * (1 - plain(2)) * (1 - plain(0))) and r[2].score == pytest.approx(leak)
    # the likelihood's gradient: a step along it never makes the fit worse
    bags = [(1, [[0], [1]]), (0, [[1]]), (1, [[2, 0]]), (0, []), (0, [[1], [1]])] * 20
    weights, b, k = toxicity.fit(bags, 3)
    p = [toxicity.noisy_or([toxicity.sentence_score(s, weights, b) for s in x], k) for _, x in bags]
    assert all((v > 0.5) == (y == 1) for v, (y, _) in zip(p, bags)) and weights[0] > weights[1] < weights[2]
    rows = [(i, t, "en", "a", None, "x", 7, "y", 1, True) for i, t in ((1, "same"), (2, "same"), (3, "other"), (4, None), (9, "fine"), (9, "again"))]
    both = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1), (9, 0), (4, 1)], "doc_id long, toxic int")
    for parts in (1, 3, 5):
        got = {r.text: r.toxic for r in toxicity.training_rows(spark.createDataFrame(rows, DOCS).repartition(parts), both, 100).collect()}
        assert set(got) <= {"same", "other", "fine", "again"} and got.get("other", 1) == 1 and ("same" not in got or got["same"] == 1)


def test_token_counts_whole_table(real):
    """Every row against greedy longest match over its words."""
    voc = token_counts.pieces(token_counts.MODEL).id
    longest = max(map(len, voc))

    def greedy(s):
        n = i = 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in voc), None)
            if j is None:
                return 0
            n, i = n + 1, j
        return n

    known = {}
    got = {r.doc_id: r for r in token_counts.count_tokens(real).collect()}
    for r in real.collect():
        counts = [known[w] if w in known else known.setdefault(w, greedy("▁" + w)) for w in r.text.split()]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_unknown, got[r.doc_id].n_tokens) == (len(counts), counts.count(0), sum(counts) + counts.count(0))


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    seen = materialise(quality.views(documents))
    models = quality.train(seen, train)
    r = quality.score_documents(seen, models).join(test, "doc_id").toPandas()
    assert ((r.score >= 0.5) == (r.quality == 1)).mean() > 0.95
    rows = quality.score_documents(quality.views(odd), models).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id == 4}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(quality.views(none), models).count() == 0
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.count() == len(ODD) and kept.columns == odd.columns
    few = train.orderBy(F.xxhash64("doc_id")).limit(120)
    right = lambda rounds: ((r := quality.score_documents(seen, quality.train(seen, few, rounds=rounds)).join(test, "doc_id").toPandas()).score.ge(0.5) == (r.quality == 1)).mean()
    assert right(2) >= right(0) - 0.005  # the exchange does no harm


def test_quality_round_brute_force(spark):
    """One exchange of pseudo-labels and the calibration against plain computations."""
    scored = spark.createDataFrame([(f"k{i}", i / 40) for i in range(41)] + [("t1", 1.0), ("t2", 0.0)], "key string, p_text double")
    got = {r.key: r.label for r in quality.pseudo_labels(scored, "p_text", 3, 0.9).collect()}
    sure = {k: p for k, p in [(f"k{i}", i / 40) for i in range(41)] + [("t1", 1.0), ("t2", 0.0)] if p >= 0.9 or p <= 0.1}
    assert len(got) == 6 and set(got) <= set(sure) and all(v == (sure[k] > 0.5) for k, v in got.items())
    assert {"k40", "t1", "k39"} <= set(got) and {"k0", "t2", "k1"} <= set(got)
    lopsided = quality.pseudo_labels(scored, "p_text", 3, 0.5, 5 / 6).collect()  # five good, one bad
    assert sorted(r.label for r in lopsided) == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.5).astype(float)
    noise = quality.Calibrated(quality.Logistic(rng.normal(size=(300, 4)), y), rng.normal(size=300), y)  # a view that knows nothing is sure of nothing
    assert np.abs(noise.logit(rng.normal(size=(500, 4)))).max() < np.log(0.97 / 0.03)
    a, b = rng.normal(size=(300, 4)) + y[:, None], rng.normal(size=(300, 3)) + 0.2 * y[:, None]
    folds = np.arange(300) % 3
    extra = (rng.normal(size=(20, 4)) + 1, np.ones(20))
    none = (np.empty((0, 3)), np.empty(0))
    joint = quality.calibrate(a, b, y, extra, none, folds)
    odds = np.zeros((300, 2))
    for i in range(300):  # each row by models of the other folds
        rest = folds != folds[i]
        if i < 3:
            plain = quality.Logistic(np.vstack([a[rest], extra[0]]), np.concatenate([y[rest], extra[1]]), np.concatenate([np.ones(rest.sum()), np.full(20, 0.5)]))
            odds[i, 0] = plain.logit(a[i : i + 1])[0]
            assert odds[i, 0] == pytest.approx(quality.fit_view(a, y, extra, rest).logit(a[i : i + 1])[0])
    p = 1 / (1 + np.exp(-joint.logit(np.array([[3.0, 0.5], [-3.0, -0.5]]))))
    assert p[0] > 0.7 and p[1] < 0.3


PAGE = """<html><head><title>t</title><script>if (a < b) x("<p>no</p>")</script></head><body><div class="topline"><p>Site motto for all</p></div>
<div><h1>Head {n}</h1><p>Text &amp; more &eacute; {n}<br>next&nbsp;line<ul><li>one {n}<li>two {n}</ul><p>last {n}</div><div><span>Bottom line</span></div></body></html>"""


def test_html(spark):
    rows = [(i, "http://h.example/%d" % i, PAGE.format(n=i)) for i in range(12)]
    rows += [(50, "http://other.example/", PAGE.format(n=50)), (51, None, None), (52, "x", ""), (53, "http://h.example/a", "<article><h2>T</h2><p>Site motto for all</p><aside>no</aside><div class='comments'><p>no</p></div></article><p>no</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("gone", F.lit(2))
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert html_text.extract_text(df).count() == len(rows)
    assert got[3].text == "Head 3\n\nText & more é 3 next line\n\none 3\n\ntwo 3\n\nlast 3" and got[3].n_chars == len(got[3].text)
    assert got[50].text == "Site motto for all\n\nHead 50\n\nText & more é 50 next line\n\none 50\n\ntwo 50\n\nlast 50\n\nBottom line"  # no template of its own host
    assert got[51].text == got[52].text == "" and got[53].text == "T\n\nSite motto for all"
    assert html_text.extract_text(df.limit(0)).count() == 0


def _texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_templates_inside_main(spark):
    box = "<div class='x1'><p>Follow us</p><p>All rights kept</p></div>"
    rows = [(i, f"http://m.example/{i}", f"<body><main><p>Own text {i}</p><p>Said {i % 4}</p>{box}</main></body>") for i in range(12)]
    rows += [(20 + i, f"http://few.example/{i}", f"<body><main><p>Own text {i}</p>{box}</main></body>") for i in range(5)]
    rows += [(40, "http://w.example/", "<div class='content has-sidebar'><article><header><h1>T</h1></header><p>Text</p></article></div><div class='related'><article>no</article></div>"),
             (41, "http://w.example/", "<div><article>Text</article></div><div class='sidebar'><article>no</article></div>"),
             (42, "http://w.example/", "<p>Text</p><div class='comments'><article>no</article></div>"), (43, "http://w.example/", "<div hidden class='sidebar'><main>no</main></div><p>Text</p>")]
    got = _texts(spark, rows)
    assert all(got[i] == f"Own text {i}\n\nSaid {i % 4}" for i in range(12))
    assert all(got[20 + i] == f"Own text {i}\n\nFollow us\n\nAll rights kept" for i in range(5))
    assert got[40] == "T\n\nText" and got[41] == got[42] == got[43] == "Text"


def test_html_inside_articles(spark):
    """Titles and sections keep what their class names might say; removed elements inside a line leave it whole."""
    rows = [(1, "http://i.example/", "<main><header class='entry-header'><h1>Title</h1></header><section class='related-work'><p>Prior art</p></section><div class='post-header'>By me</div></main>"),
            (2, "http://i.example/", "<article><p>see <svg><text>no</text></svg> icon, <button>no</button>a <span class='ad'>no</span>line <select><option>no</select>on</p><p>E = <math><mi>m</mi></math>c</p></article>"),
            (3, "http://i.example/", "<body><p>one <span class='notice'>no</span>two</p><p>a <button>no<p>three</body>"),
            (4, "http://i.example/", "<article><p>x</p><div class='comments'><p>no</p></div><ul class='comment-list'><li>no</ul><p>y</p></article>")]
    got = _texts(spark, rows)
    assert got[1] == "Title\n\nPrior art\n\nBy me" and got[2] == "see icon, a line on\n\nE = mc"
    assert got[3].startswith("one two\n\na") and got[4] == "x\n\ny"


def test_html_counting_brute_force(spark):
    """Counts of contents per host, section and subtree against a plain loop; repeated rows change nothing."""
    random.seed(9)
    bits = [f"<div><p>Part {k}</p></div>" for k in range(14)]
    rows = [(i, f"http://{random.choice('ab')}.example/{random.choice(['', 'x/', 'y/'])}{i}",
             "<body>" + "".join(random.sample(bits, 5)) + random.choice(["<article><p>Own %d</p>%s</article>", "<p>Own %d</p>%s"]) % (i % 25, random.choice(bits[:3])) + "</body>") for i in range(90)]
    read = {i: html_text.Page(h) for i, _, h in rows}
    contents, holders = {}, {}
    for i, url, _ in rows:
        host, rest = url[7:].split("/", 1)
        areas = [host] + ([f"{host}/{rest.split('/')[0]}"] if "/" in rest else [])
        for area in areas:
            contents.setdefault(area, set()).add(read[i].text(set()))
            for h in read[i].templates():
                holders.setdefault((area, h), set()).add(read[i].text(set()))
    gone = {(a, h) for (a, h), c in holders.items() if (len(c) >= 10 and len(c) >= 0.5 * len(contents[a]) if h & 1 else len(c) >= 5 and len(c) >= 0.1 * len(contents[a]))}
    want = {}
    for i, url, _ in rows:
        host, rest = url[7:].split("/", 1)
        areas = [host] + ([f"{host}/{rest.split('/')[0]}"] if "/" in rest else [])
        want[i] = read[i].text({h for a, h in gone if a in areas})
    assert gone and _texts(spark, rows) == want == _texts(spark, rows + rows[:40] * 3)
    assert sum(want[i] != read[i].text(set()) for i in want) > 20


def test_html_counts_contents(spark):
    page = "<body><div><p>Story {n}</p><p>More of {n}</p></div>{rest}</body>"
    rows = [(i, f"http://c.example/p?track={i}", page.format(n="one", rest="")) for i in range(8)]  # one story at many urls
    rows += [(10 + i, f"http://c.example/q{i}", page.format(n=i, rest="")) for i in range(60)]
    rows += [(100 + i, f"http://c.example/blog/{i}", page.format(n=f"b{i}", rest="<div><p>Blog motto</p></div>")) for i in range(6)]
    got = _texts(spark, rows)
    assert all(got[i] == "Story one\n\nMore of one" for i in range(8)) and all(got[10 + i] == f"Story {i}\n\nMore of {i}" for i in range(60))
    assert all(got[100 + i] == f"Story b{i}\n\nMore of b{i}" for i in range(6))  # on 6 of 67 contents of the host, but all of its section


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    start = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality_stage(spark, start, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert sum(q == 1 and i not in ids for i, q in labels.items()) <= 2
    exact = P.exact_stage(spark, start, SF)
    texts = {r.text: max(x.doc_id for x in start.where(F.col("text") == r.text).collect()) for r in start.groupBy("text").count().where("count > 1").collect()}
    want = {r.doc_id for r in start.collect() if texts.get(r.text, r.doc_id) == r.doc_id}
    assert {r.doc_id for r in exact.collect()} == want
    near = P.near_stage(spark, exact, SF)
    groups = _brute_groups([(r.doc_id, r.text) for r in exact.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {i for i, g in groups.items() if g[1] == i}
    mixed = P.mixing_stage(spark, near, SF)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.taken_words(near).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) * size == t for i, (t, size) in taken.items())
    for stage in (kept, exact, near, mixed):
        assert stage.columns == start.columns
    out = P.encoding_stage(spark, mixed, SF)
    assert out.count() == mixed.count() and all(r.decoded == r.text for r in sentencepiece_dropout.decode_column(out).limit(20).collect())


def test_temporary_names(spark, odd):
    """Columns named as the temporary ones of dropping and mixing keep their values."""
    names = ["__key", "__KEY_", "__gone", "__nth", "__row", "__times", "__copy"]
    named = odd.select("*", *[F.lit(name).alias(name) for name in names])
    for work in (exact_dedup.drop_duplicates, mixing.mixed_rows):
        want, got = work(odd), work(named)
        assert got.columns == named.columns
        assert sorted(map(repr, got.select(*odd.columns).collect())) == sorted(map(repr, want.collect()))
        assert all(tuple(r) == tuple(names) for r in got.select(*names).collect())
