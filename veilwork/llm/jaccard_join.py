"""N-gram Jaccard join by vertical partitioning, and the groups it gives.

The global order of shingles is the order of their 64-bit hashes. Cut into F fragments, two sets that differ in at
most D shingles agree in at least F - D fragments, and the rest only adds partial overlaps. So with F > D every linked pair
shares a whole fragment, which one equi-grouping finds without counting frequencies:

1. Each document gives its set size, the class of its set, keys of its first D + 1 non-empty fragments, and a sketch. No more are needed: all fragments
   before the first one that two linked sets hold alike differ, and at most D do, so that one is among the first D + 1 of both. Fragment counts come from
   size classes; a document near the top of its class gives keys for the next one too. F has slack for empty fragments;
   the few sets with no more than D others also give the keys of a plain prefix filter: two of them may have no fragment alike, while a set
   with more has one alike with every partner. The sketch has one byte of hash for each of a larger number of fine fragments.
2. Sets that share a key are compared by their sketches: fine fragments that differ are counted, each of them
   stands for a shingle of one set only, and the pair goes on when the sum is no more than linked sets can differ in. Passages that many documents share
   give keys in common, but not such pairs. Groups of a key are walked from set to set (no pair is met twice once both are reached). Large groups of much the same sets are made one,
   so that near copies are not compared anew for every key that they share, and cut into blocks. The connected parts of what goes on are families; a linked pair is always in one.
3. Families are cut into bounded blocks; for each pair of blocks partial overlaps are counted fragment by
   fragment of the order, summed per pair, and compared with the threshold exactly. A spanning forest and link counts
   leave the task, not the pairs.

Equal sets are one class throughout, so groups of copies cost one member. A class is a 64-bit hash of the sorted set. Very large sets have more fine fragments than a sketch keeps (MOST_SKETCH);
those it keeps are a random part of the order, and the bound is 7 standard deviations over what linked sets are expected to differ in there, so that less than one link in 10^10 is lost.

Text is lower-cased A-Z only; words are runs without ASCII white space. With fewer words than a shingle the whole sequence is one
shingle; null, empty or blank texts have no shingles and link with nothing. Rows repeating a doc_id are joined like
others; a null doc_id never becomes a component id unless its whole component has none. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, components, drop_written, give_back, materialise, row_key, table, without_rows

RATIO = 1.4  # of the bounds of neighbouring size classes
BLOCK_DOCS, BLOCK_SHINGLES = 128, 600_000
FINE, MOST_SKETCH = 3.5, 256  # fine fragments for each shingle that linked sets can differ in, and most of them kept
SMALL, FEW, KEY_BLOCK = 8, 64, 1024  # sets of a key that are compared pair by pair, that are looked up as one group, and in a block of a larger one
COLUMNS = 4096  # shingles of one fragment of the order when overlaps are counted


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words; the words seen are kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = _mix(s + h[i : len(h) - width + 1 + i])
    return np.unique(s)


class Cuts:
    """Size classes and their fragment counts for sets of similarity >= percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = next(n for n in range(1, 10**6) if self.apart(n, n + 1) >= 1 and n * 100 >= percent * (n + 1))
        self.low = [self.least]
        while self.low[-1] < 1 << 40:
            self.low.append(math.ceil(self.low[-1] * RATIO) + 1)
        self.parts, self.fine = [], []
        for low, high in zip(self.low, self.low[1:]):
            d, slack = self.apart(high - 1, high - 1), 1
            for _ in range(20):
                f = d + 1 + slack
                empty = f * math.exp(-(low * percent / 100) / f)
                slack = math.ceil(empty + 4 * math.sqrt(empty)) + 1
            self.parts.append(d + 1 + slack)
            self.fine.append(max(8, math.ceil(FINE * d)))

    def apart(self, a: int, b: int) -> int:
        """Most shingles that two linked sets of these sizes hold in one only."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def labels(self, n: int) -> list[int]:
        if n < self.least:
            return []
        k = int(np.searchsorted(self.low, n, side="right")) - 1
        return [k, k + 1] if n * 100 // self.percent >= self.low[k + 1] else [k]

    def differ(self, n: int, k: int) -> int:
        """Most shingles in one only of a set of size n and one that it is to be found with in size class k."""
        top = n * 100 // self.percent
        return self.apart(n, min(top, self.low[k + 1] - 1) if n >= self.low[k] else top)

    def marks(self, s: np.ndarray) -> list[tuple[int, bytes, np.ndarray]]:
        """(size class, sketch, keys) of each of a set's size classes."""
        out = []
        mixed = None
        for k in self.labels(len(s)):
            if mixed is None:
                mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
            f = self.parts[k]
            bounds = np.searchsorted(s, (np.arange(1, f, dtype=np.float64) * (2.0**64 / f)).astype(np.uint64))
            edge = np.concatenate([[0], bounds, [len(s)]])
            full = edge[1:] > edge[:-1]
            d = self.differ(len(s), k)
            first = np.nonzero(full)[0][: d + 1]
            keys = _mix((mixed[edge[first + 1]] - mixed[edge[first]]) ^ _mix(first.astype(np.uint64) + np.uint64((k + 1) << 34)))
            if len(first) <= d:
                prefix = s[: len(s) - -(-len(s) * self.percent // 100) + 1]
                keys = np.concatenate([keys, _mix(prefix ^ _mix(np.full(len(prefix), (k + 1) << 50, np.uint64)))])
            fine = self.fine[k]
            width = min(fine, MOST_SKETCH)
            edge = np.searchsorted(s, (np.arange(1, width + (fine > width), dtype=np.float64) * (2.0**64 / fine)).astype(np.uint64))
            edge = np.concatenate([[0], edge, [len(s)] if fine == width else []]).astype(np.int64)
            sketch = (_mix(mixed[edge[1:]] - mixed[edge[:-1]]) >> np.uint64(56)).astype(np.uint8)
            out.append((k, sketch.tobytes(), keys))
        return out

    def most_apart(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most fine fragments of a sketch that differ between linked sets of sizes a and b."""
        d = (100 - self.percent) * (a + b) // (100 + self.percent)
        share = np.minimum(1.0, MOST_SKETCH / np.array(self.fine)[label])
        return np.where(share == 1, d, np.floor(d * share + 7 * np.sqrt(d * share) + 7))


def walk(rows: np.ndarray, sketch: np.ndarray, size: np.ndarray, label: np.ndarray, scheme: Cuts, edges: list) -> None:
    """Edges of a spanning forest of the pairs among rows whose sketches are near enough."""
    left = rows
    while len(left):
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            at = max(1, (1 << 15) // len(left))
            some, front = front[:at], front[at:]
            apart = (sketch[some][:, None, :] != sketch[left][None, :, :]).sum(2)
            near = (apart <= scheme.most_apart(label[left][None, :], size[some][:, None], size[left][None, :])).any(0)
            found = left[near]
            edges.append((found, np.full(len(found), first)))
            front, left = np.concatenate([front, found]), left[~near]


def near_in_groups(b: pd.DataFrame, scheme: Cuts) -> pd.DataFrame:
    """Edges (a, b) of sets near enough to be linked, for whole groups of rows (key, p, q, class, n, label, sketch) in order."""
    by = b[["key", "p", "q"]].to_numpy()
    change = np.concatenate([[0], np.nonzero((by[1:] != by[:-1]).any(1))[0] + 1, [len(b)]])
    group = np.repeat(np.arange(len(change) - 1), np.diff(change))
    many = np.diff(change)[group]
    cls, size, label = (b[c].to_numpy() for c in ("class", "n", "label"))
    sketch = np.frombuffer(b"".join(x.ljust(MOST_SKETCH, b"\0") for x in b["sketch"]), np.uint8).reshape(len(b), MOST_SKETCH)
    edges = []
    for d in range(1, SMALL):
        i = np.nonzero((many[:-d] <= SMALL) & (group[d:] == group[:-d]))[0] if d < len(b) else np.empty(0, np.int64)
        near = (sketch[i] != sketch[i + d]).sum(1) <= scheme.most_apart(label[i], size[i], size[i + d])
        edges.append((i[near], i[near] + d))
    for g in np.unique(group[many > SMALL]):
        rows = np.arange(change[g], change[g + 1])
        walk(rows[np.unique(cls[rows], return_index=True)[1]], sketch, size, label, scheme, edges)
    a, c = (cls[np.concatenate(x)] for x in zip(*edges))
    return pd.DataFrame({"a": a, "b": c})[a != c].drop_duplicates()


def near_edges(tagged: DataFrame, scheme: Cuts) -> DataFrame:
    """Edges (a, b) from rows (key, p, q, class, n, label, sketch): groups of (key, p, q) are taken whole, in runs of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            b = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(b):
                continue
            by = b[["key", "p", "q"]].to_numpy()
            last = np.nonzero((by != by[-1]).any(1))[0]
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield near_in_groups(b.iloc[:at], scheme)
            rest = b.iloc[at:]
        if rest is not None:
            yield near_in_groups(rest, scheme)
        del rest
        give_back()

    return tagged.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInPandas(run, "a long, b long")


def merged(hits: DataFrame) -> DataFrame:
    """Rows (label, key, class), each once, of large groups (label, key, class, low: the smallest class of the key). Groups with the same smallest class become one, and what they give with the same
    smallest hash of another kind; classes are hashes, so two groups become one with the chance of their likeness. No group loses a set."""
    groups = materialise(hits.select("label", F.xxhash64("low", "label").alias("key"), "class").distinct())
    least = materialise(groups.groupBy("label", "key").agg(F.min(F.xxhash64("class", "label")).alias("least")))
    return materialise(groups.join(least, ["label", "key"]).select("label", F.col("least").alias("key"), "class").distinct())


def in_blocks(hits: DataFrame) -> DataFrame:
    """Large groups (label, key, class, low) as rows (key, label, p, q, class) of pairs of blocks. From some size on there are as many blocks as the root of the size says: rows
    grow by the power 1.5, not 2, and the sets of a pair of blocks by 0.5."""
    groups = merged(hits)
    size = groups.groupBy("label", "key").agg((F.count("*") / KEY_BLOCK).alias("size"))
    size = materialise(size.select("label", "key", F.ceil(F.least(F.col("size"), 4 * F.sqrt("size"))).cast("int").alias("blocks")))
    rows = groups.join(size, ["label", "key"]).withColumn("block", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", "label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "class")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, scheme: Cuts, with_key: bool) -> DataFrame:
    """doc_id, key, n, class (null: no shingles), marks. A class's marks come once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            n, cls, marks = [], [], []
            for text in batch["t"]:
                s = shingle_set(text, k, hashes)
                c = int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())))) if len(s) else None
                n.append(len(s))
                cls.append(c)
                if c is None or c in seen:
                    marks.append(None)
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                marks.append([{"label": m[0], "sketch": m[1], "keys": m[2].view(np.int64)} for m in scheme.marks(s)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n": n, "class": pd.array(cls, dtype="Int64"), "marks": marks})
        del hashes, seen
        give_back()

    key = row_key(id_col, text_col) if with_key else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("t")).mapInPandas(
        run, "doc_id long, key string, n long, class long, marks array<struct<label: int, sketch: binary, keys: array<long>>>")


def overlap_links(sets: list[np.ndarray], left: np.ndarray, within: bool, percent: int) -> np.ndarray:
    """Boolean matrix of linked pairs. left: mask of the first block's sets; pairs are within it, or cross to the rest."""
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column) > 1  # a shingle of one set adds to no overlap
    keep = many[column]
    owner, column = owner[keep], (np.cumsum(many) - 1)[column[keep]]
    shared = np.zeros((len(sets), len(sets)))
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(column, column[at] + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[at:stop], column[at:stop] - column[at]] = 1
        shared += part @ part.T
        at = stop
    link = shared * (100 + percent) >= percent * (size[:, None] + size[None, :])
    np.fill_diagonal(link, False)
    return link if within else link & (left[:, None] != left[None, :])


def roots(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row that it is connected with."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.nonzero(link[front].any(0) & (root < 0))[0]
                root[front] = i
    return root


def by_group(names: list[str], work, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """work(rows of one group) for batches sorted by the columns names; groups may run over batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.nonzero((batch[names].to_numpy()[1:] != batch[names].to_numpy()[:-1]).any(1))[0] + 1
        edge = [0, *change, len(batch)]
        done = []
        for a, b in zip(edge, edge[1:]):
            part = batch.iloc[a:b]
            if rest and tuple(rest[0][names].iloc[0]) != tuple(part[names].iloc[0]):
                done.append(work(pd.concat(rest) if len(rest) > 1 else rest[0]))
                rest = []
            rest.append(part)
        if done:
            yield pd.concat(done)
    if rest:
        yield work(pd.concat(rest) if len(rest) > 1 else rest[0])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, with_key: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (other rows linked directly), and with_key its row_key() and a number of its group."""
    bound_arrow_batches(docs.sparkSession)
    scheme = Cuts(percent)
    found = materialise(_sets(docs, id_col, text_col, shingle, scheme, with_key))
    sets = materialise(found.select("doc_id", "key", "n", "class"))
    classes = materialise(sets.where("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("members"), F.max("n").alias("n")))
    marks = found.select("class", "n", F.explode("marks").alias("m")).select("class", "n", "m.label", "m.sketch", "m.keys")
    keys = marks.select("class", "label", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows")).where("low <> high")
    shared = materialise(shared.select("key", "rows", F.when(F.col("rows") > FEW, F.col("low")).alias("low")))
    hits = materialise(keys.join(shared, "key").select("key", "class", "label", "rows", "low"))
    sketches = materialise(marks.select("class", "label", "n", "sketch").dropDuplicates(["class", "label"]))
    drop_written(found)
    # Near copies share most of their keys: small groups of the same sets are compared once, whatever the key
    few = hits.where(F.col("rows") <= FEW).groupBy("key").agg(F.array_sort(F.collect_set("class")).alias("members"), F.min("label").alias("label"))
    few = few.groupBy("label", "members").agg(F.min("key").alias("key")).select("key", "label", F.lit(0).alias("p"), F.lit(0).alias("q"), F.explode("members").alias("class"))
    many = in_blocks(hits.where(F.col("rows") > FEW))
    tagged = few.unionByName(many).join(sketches, ["class", "label"]).select("key", "p", "q", "class", "n", "label", "sketch")
    near = materialise(near_edges(tagged, scheme).distinct())
    drop_written(hits)
    drop_written(sketches)
    family = materialise(components(near))
    members = materialise(classes.join(family, classes["class"] == family["node"]).select("class", "first_id", "members", "n", F.col("component_id").alias("family")))
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    members = materialise(members.join(materialise(blocks), "family").withColumn("block", F.pmod(F.xxhash64("class"), "blocks")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    # One row per class even if rows repeat an id: of rows with that id only texts of the class's own set count.
    wanted = texts.join(members.hint("merge"), texts["id"] == members["first_id"])  # one plan at every size

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            found = [shingle_set(t, shingle, hashes) for t in b["t"]]
            own = [len(s) > 0 and int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())))) == c for s, c in zip(found, b["class"])]
            b = b.assign(tokens=[s.tobytes() for s in found])[own]
            yield b[["class", "family", "block", "blocks", "members", "tokens"]]
        del hashes
        give_back()

    loaded = wanted.select("class", "family", "block", "blocks", "members", "t").mapInPandas(
        tokens, "class long, family long, block long, blocks long, members long, tokens binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = loaded.withColumn("other", other).select(
        "class", "family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "members", "tokens")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("class")
        p, q = rows["p"].iloc[0], rows["q"].iloc[0]
        cls = rows["class"].to_numpy()
        link = overlap_links([np.frombuffer(t, np.uint64) for t in rows["tokens"]], (rows["block"] == p).to_numpy(), p == q, percent)
        return pd.DataFrame({"class": cls, "root": cls[roots(link)], "links": link @ rows["members"].to_numpy()})

    linked = materialise(pairs.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q").mapInPandas(
        lambda batches: by_group(["family", "p", "q"], compare, batches), "class long, root long, links long"))
    comp = components(linked.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    comp = materialise(comp.withColumnRenamed("node", "class"))
    lowest = classes.join(comp, "class").groupBy("component_id").agg(F.min("first_id").alias("lowest"))
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(comp.join(materialise(lowest), "component_id"), "class", "left").join(links, "class", "left").select(
        F.col("class").alias("c"), F.coalesce("component_id", "class").alias("group"), F.coalesce("lowest", "first_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
    return sets.join(materialise(known), F.col("class") == F.col("c"), "left").select(
        *(["key", "group"] if with_key else []), "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one row of each group of linked documents: one of the smallest id. Texts without shingles all stay."""
    rows = materialise(similar_groups(docs, id_col, text_col, shingle, percent, with_key=True).where("n_shingles > 0"))
    heads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Rows that repeat the smallest id of their group with other texts: the one of the smallest key stays
    first = rows.where(heads).groupBy("group").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    again = rows.where(heads).join(first, "group").where("key <> first").select("key")
    return without_rows(docs, rows.where(~heads).select("key").unionByName(again), id_col, text_col, once=True)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op5_jaccard_join(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)
