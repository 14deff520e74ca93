"""Periodic runs of words: squares seeded by a suffix automaton whose end-position sets are merged small to large, extended to maximal runs.

A run is a stretch of consecutive words with smallest period q and length of at least max(least, times * q) that no neighbouring word extends keeping the period. In the
automaton of a stretch, two neighbouring end positions of one state whose distance d does not exceed the state's length mark a square of period d. Ends are kept in order;
a smaller set is put into the larger one of the state that it hangs on, and each end put in gives its two new neighbour distances.

What cannot lie in a run is left out of the automaton, exactly: every k-gram of a run recurs inside the run, k = least * (times - 2) / times + 1 (9 by default). So a
document is cut where a k-gram does not recur, the pieces are looked at again by themselves, and pieces that get too short go.

A task holds one document's automaton at a time. Null and empty texts have no words and no runs. A null id stays. Repeated rows give equal rows. Empty tables give empty
results; only the id and text columns are read, so other columns do no harm. Ids may have any type.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import bound_arrow_batches, give_back, table

WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def recurring(words: list[bytes], least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint stretches [from, to) of at least `least` words that contain every run."""
    k = least * (times - 2) // times + 1
    if len(words) < least:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    grams = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        grams = grams * MIX + h[j : len(h) - k + 1 + j]
    todo, found = [(0, len(grams))], []
    while todo:
        low, high = todo.pop()
        part = grams[low:high]
        ordered = np.sort(part)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        spots = twice.searchsorted(part)
        keep = twice[np.minimum(spots, len(twice) - 1)] == part
        if keep.all():
            found.append((low, high + k - 1))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
        todo += [(low + a, low + b) for a, b in edges.reshape(-1, 2).tolist() if b - a + k - 1 >= least]
    return found


def squares(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, end, distance): the `length` words up to `end` (exclusive) stand there and `distance` words earlier; distance <= length."""
    step, link, size, first = [{}], [-1], [0], [[]]
    last = 0
    for i, c in enumerate(w, 1):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(i)
        first.append([-i])  # ends are kept negative: a state's own end is its first, so most ends are put in at the back
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append([])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    del step
    for v in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
        p = link[v]
        if p <= 0:
            first[v] = None
            continue
        small, large, length = first[p], first[v], size[p]
        if len(small) > len(large):
            small, large = large, small
        for x in small:
            at = bisect_left(large, x)
            if at < len(large) and large[at] - x <= length:
                yield length, -x, large[at] - x
            if at and x - large[at - 1] <= length:
                yield length, -large[at - 1], x - large[at - 1]
            large.insert(at, x)
        first[p], first[v] = large, None


def alike(w: list[int], i: int, j: int) -> int:
    """How many words agree from places i < j on."""
    n, block, most = 0, 8, len(w) - j
    while block and n < most:
        block = min(block, most - n)
        if w[i + n : i + n + block] == w[j + n : j + n + block]:
            n += block
            block *= 2
        else:
            block //= 2
    return n


def primitive(w: list[int], start: int, period: int) -> bool:
    """Whether the `period` words from start on are no power of fewer."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if w[start : start + period - part] == w[start + part : start + period]:
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def runs_in(w: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch."""
    back = w[::-1]
    known: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends of the repetitions met, in order
    for length, end, d in squares(w):
        starts, ends = known.setdefault(d, ([], []))
        begin = end - d - length
        at = bisect_left(starts, begin + 1)
        if at and ends[at - 1] >= end:
            continue
        start = begin - alike(back, len(w) - end + length, len(w) - begin)
        stop = end + alike(w, end - d, end)
        at = bisect_left(starts, start)
        starts.insert(at, start)
        ends.insert(at, stop)
    return [(a, b - a, d) for d, (starts, ends) in known.items() for a, b in zip(starts, ends) if b - a >= max(least, times * d) and primitive(w, a, d)]


def find_runs(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found = []
    for low, high in recurring(words, least, times):
        number: dict[bytes, int] = {}
        w = [number.setdefault(x, len(number)) for x in words[low:high]]
        found += [(low + a, n, q) for a, n, q in runs_in(w, least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _rows(docs: DataFrame, id_col: str, text_col: str, row, fields: list[StructField]) -> DataFrame:
    """Arrow batches of ids and UTF-8 texts to rows of fields; str.split() would cut at more than the six white-space bytes that bytes.split() knows."""
    bound_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    kinds = {LongType(): pa.int64(), StringType(): pa.string()}
    names, types = [f.name for f in fields], [kinds.get(f.dataType) or pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [row(t.as_py().split()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * len(types), types))], ["doc_id", *names])
        give_back()

    return texts.mapInArrow(run, StructType([StructField("doc_id", texts.schema["doc_id"].dataType), *fields]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs (array of start, length, period in words) and collapsed (the text without repeats, words joined by one space) of every row."""
    def row(words: list[bytes]) -> tuple:
        runs = find_runs(words, least, times)
        return [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode()

    kind = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))
    return _rows(docs, id_col, text_col, row, [StructField("runs", kind), StructField("collapsed", StringType())])


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Per row: doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli), and SHA-256 of all runs and of the collapsed text."""

    def row(words: list[bytes]) -> tuple:
        runs = find_runs(words, least, times)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())

    longs = [StructField(n, LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    return _rows(docs, id_col, text_col, row, [*longs, StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())])


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id and text) in which every tenth document by crc32 of its id is made periodic from a word on; a null id is none of them."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0))
    rows = docs.select(id_col, text_col, h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long")))
    rows = rows.withColumn("a", F.pmod("g", "n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    periodic = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int") + 1))
    return rows.select(id_col, F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col(text_col)).alias(text_col))


def op12_periodic_runs(spark, sf_dir):
    return run_digests(planted(table(spark, sf_dir, "documents")))
