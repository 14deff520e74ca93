"""Spelling variants: every word's neighbours at distance one, found by intersecting its Levenshtein automaton with broadcast trie shards.

Words are counted by Spark columns. The counted words are sorted and cut into shards; each is a trie in flat arrays (children of a node side by side), built by a task.
Shards go to the executors as broadcasts, a bounded number of bytes at a time; every word's automaton (exactly one code point inserted, deleted or replaced) walks every
shard of the pass depth-first and gives the number of neighbours and the commonest one. Partial results of shards are added up per word, and chains of forms are followed
by doubling.

Null and empty texts have no words; a null id counts as an empty one. Repeated rows count again. Empty tables give empty results; only the id and text columns are read.
Words may have any length: a shard ends at `shard_chars` code points or after one longer word, and a walk is linear in the word's length.
"""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, drop_written, give_back, materialise, table

LETTER = "[A-Za-zÀ-ÿ]"  # one byte each in Latin-1, whose byte order is that of code points
CHAINS = 6  # doublings: a form is at least `ratio` (2 or more) times as frequent, so a chain has at most 63 steps


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_n: int = 2, noise: int = 0) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lower-cased, of at least least_chars code points and least_n occurrences.

    With noise, an occurrence whose h = crc32("<id>:<run>") is divisible by it loses its code point number h % length (planted misspellings)."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTER}{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    if noise:
        rows = rows.select("id", run.alias("run"))
        rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        run = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = rows.select(run.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class Trie:
    """Words in flat arrays, level by level: the children of node v are the nodes first[v] to first[v + 1]; word[v] is a word's number plus one."""

    def __init__(self, label: bytes, first: array, word: array, counts: array):
        self.label, self.first, self.word, self.counts = label, first, word, counts

    @classmethod
    def build(cls, words: list[bytes], counts: list[int]) -> Trie:
        """words: sorted, distinct, none empty."""
        labels, firsts, ends = [bytearray(1), bytearray()], [array("I", [0])], [array("I", [0])]
        last = b""
        for k, w in enumerate(words, 1):
            same, most = 0, min(len(last), len(w))
            while same < most and last[same] == w[same]:
                same += 1
            for d in range(same + 1, len(w) + 1):
                if d == len(firsts):
                    labels.append(bytearray())
                    firsts.append(array("I"))
                    ends.append(array("I"))
                labels[d].append(w[d - 1])
                firsts[d].append(len(labels[d + 1]))
                ends[d].append(0)
            ends[len(w)][-1] = k
            last = w
        label, first, word, below = bytearray(), array("I"), array("I"), 1
        for d, level in enumerate(firsts):
            label += labels[d]
            word.extend(ends[d])
            first.extend(below + x for x in level)
            below += len(labels[d + 1])
        first.append(len(label))
        return cls(bytes(label), first, word, array("q", counts))

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.label, self.first.tobytes(), self.word.tobytes(), self.counts.tobytes()

    @classmethod
    def unpack(cls, label: bytes, first: bytes, word: bytes, counts: bytes) -> Trie:
        made = [array(kind) for kind in "IIq"]
        for a, b in zip(made, (first, word, counts)):
            a.frombytes(b)
        return cls(bytes(label), *made)

    def near(self, w: bytes) -> Iterator[tuple[int, bytes]]:
        """(count, word) of every word at distance exactly one, each once.

        The walk follows w itself; at each depth one edit leaves it, after which the rest of w must match letter by letter. An edit that another place would give
        as well (a letter of a run of equal letters) is tried at one place only, so nothing comes twice and runs of equal letters cost nothing."""
        label, first, word, counts = self.label, self.first, self.word, self.counts
        find, size = label.find, len(w)

        def tail(v: int, i: int) -> int:
            while i < size:
                v = find(w[i], first[v], first[v + 1])
                if v < 0:
                    return 0
                i += 1
            return word[v]

        v = 0
        for i in range(size):
            c, low, high = w[i], first[v], first[v + 1]
            if (not i or w[i - 1] != c) and (k := tail(v, i + 1)):
                yield counts[k - 1], w[:i] + w[i + 1 :]
            onward = w[i + 1] if i + 1 < size else -1
            v = -1
            for u in range(low, high):
                x = label[u]
                if x == c:
                    v = u
                    continue
                below, end = first[u], first[u + 1]
                # w[i] replaced by x: the next letter must go on below u; x put before w[i]: w[i] must
                if onward < 0 or find(onward, below, end) >= 0:
                    if k := tail(u, i + 1):
                        yield counts[k - 1], w[:i] + bytes((x,)) + w[i + 1 :]
                if find(c, below, end) >= 0 and (k := tail(u, i)):
                    yield counts[k - 1], w[:i] + bytes((x,)) + w[i:]
            if v < 0:
                return
        for u in range(first[v], first[v + 1]):
            if k := word[u]:
                yield counts[k - 1], w + label[u : u + 1]


def trie_shards(words: DataFrame, shard_chars: int = 1 << 20) -> DataFrame:
    """The words in ranges of code-point order, as packed tries of at most shard_chars code points (or one longer word), so of at most about 9 bytes for each of these plus 8 a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counts, chars = [], [], 0

        def full() -> pd.DataFrame:
            made = Trie.build(names, counts).pack()
            return pd.DataFrame([made], columns=["label", "first", "word", "counts"])

        for b in batches:
            for w, n in zip(b["word"], b["n"]):
                w = w.encode("latin-1")
                if names and chars + len(w) > shard_chars:
                    yield full()
                    names, counts, chars = [], [], 0
                names.append(w)
                counts.append(n)
                chars += len(w)
        if names:
            yield full()
        give_back()

    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return ordered.select("word", "n").mapInPandas(run, "label binary, first binary, word binary, counts binary")


def neighbours(words: DataFrame, shard_chars: int = 1 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """Per word with a neighbour: word, n_near, near_n and near (the commonest neighbour, ties: smallest).

    words: a written table of distinct words with n. The driver holds the shards of one pass only, at most pass_bytes or one shard."""
    spark = words.sparkSession
    bound_arrow_batches(spark)
    shards = materialise(trie_shards(words, shard_chars))
    partial: list[DataFrame] = []

    def search(group: list[tuple]) -> None:
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tries = [Trie.unpack(*x) for x in sent.value]
            for b in batches:
                rows = []
                for word in b["word"]:
                    w, n, most, best = word.encode("latin-1"), 0, 0, b""
                    for t in tries:
                        for count, near in t.near(w):
                            n += 1
                            if count > most or count == most and near < best:
                                most, best = count, near
                    if n:
                        rows.append((word, n, most, best.decode("latin-1")))
                yield pd.DataFrame(rows, columns=["word", "n_near", "near_n", "near"])
            del tries
            give_back()

        partial.append(materialise(words.select("word").mapInPandas(run, "word string, n_near long, near_n long, near string")))
        sent.destroy()

    group, held = [], 0
    for row in shards.toLocalIterator():
        packed = tuple(bytes(x) for x in row)
        size = sum(map(len, packed))
        if group and held + size > pass_bytes:
            search(group)
            group, held = [], 0
        group.append(packed)
        held += size
    search(group)
    drop_written(shards)
    found = partial[0]
    for x in partial[1:]:
        found = found.unionByName(x)
    if len(partial) == 1:
        return found
    best = F.min_by(F.struct("near_n", "near"), F.struct(-F.col("near_n"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near_n", "b.near")


def group_variants(counts: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with their counts n.

    form: the commonest neighbour if it is at least ratio times as frequent; root: the last word of the chain of forms, the word itself without one."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    words = materialise(counts.select("word", "n"))
    near = materialise(neighbours(words, **options))
    out = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    has = F.col("near_n") >= ratio * F.col("n")
    out = materialise(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    drop_written(near)
    # Only words with a form are in a chain; each round looks up where the word reached so far leads to
    hops = materialise(out.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    for _ in range(CHAINS):
        onward = hops.select(F.col("word").alias("via"), F.col("to").alias("last"))
        longer = materialise(hops.join(onward, F.col("to") == F.col("via"), "left").select("word", F.coalesce("last", "to").alias("to"), F.col("last").isNotNull().alias("moved")))
        moved = longer.where("moved").limit(1).count()
        drop_written(hops)
        hops = longer.select("word", "to")
        hops._written_at = longer._written_at
        if not moved:
            break
    roots = hops.select(F.col("word").alias("w"), F.col("to").alias("root"))
    return out.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    return group_variants(word_counts(table(spark, sf_dir, "documents"), noise=31))


SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents) WHERE length(x) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i: CAST(('0x' || substr(code, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc[CAST(1 + (xor(c, b) & 255) AS INT)])), 4294967295) AS h FROM coded, tab),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.less
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.less),
best AS (SELECT word, count(*) AS n_near, max(n) AS near_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n,
  CASE WHEN b.near_n >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.near_n) END AS form FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN roots r ON r.word = f.word
"""
