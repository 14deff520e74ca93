"""Document fingerprints: the set of Lempel-Ziv phrases of a text, kept as its smallest hashes; the share that two sets have in common tells how well one would compress the other.

A text's UTF-8 bytes are parsed into dictionary phrases (each the shortest piece that is not in the dictionary yet, which takes it in). A fingerprint is the `keep` smallest
distinct 32-bit hashes of the phrases, in order, as Base64; likeness of two is the Jaccard share among the `keep` smallest of both together, exact for sets of fewer phrases.
Equal texts have equal fingerprints.

Null and empty texts have no phrases and an empty fingerprint; two empty fingerprints are alike (1), an empty and another are not (0). Repeated ids are ordered by their
text's hash, a null id comes first. A single row follows itself. Empty tables give empty results; only the id and text columns are read. Ids may have any type that can be
ordered. A task holds two documents and one Arrow batch at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import bound_arrow_batches, drop_written, give_back, materialise, table

KEEP = 128


def parse(data: bytes, begun: Iterable[bytes] = (), at: int = 0) -> list[bytes]:
    """The phrases of data from `at` on, after those begun with. A dictionary holds every prefix of its phrases, so the longest known piece can be looked for from a
    guess (the mean length so far) up or down. 0xFF, no byte of UTF-8, ends the text; a last piece that is known is no phrase."""
    seen = dict.fromkeys((b"", *begun))  # in order of their taking in
    end, n = len(data), len(seen)
    data += b"\xff"
    while at < end:
        j = at + 1 + at // n
        n += 1
        piece = data[at:j]
        if piece in seen:
            while piece in seen:
                j += 1
                piece = data[at:j]
        else:
            shorter = data[at : j - 1]
            while shorter not in seen:
                j -= 1
                piece = shorter
                shorter = data[at : j - 1]
        seen[piece] = None
        at = j
    phrases = list(seen)[1:]
    if phrases and phrases[-1].endswith(b"\xff"):
        phrases.pop()
    return phrases


def smallest(phrases: list[bytes], keep: int = KEEP) -> np.ndarray:
    """The `keep` smallest distinct hashes, in order."""
    h = np.fromiter(map(zlib.crc32, phrases), np.uint64, len(phrases))
    h = (h ^ np.uint64(0x5851F42D)) * np.uint64(0x9E3779B97F4A7C15)  # CRC32 is linear: multiply and fold twice
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * keep:  # sort only what is likely to be needed
        low = np.unique(np.partition(h, 2 * keep)[: 2 * keep])
        if len(low) >= keep:
            return low[:keep]
    return np.unique(h)[:keep]


def encoded(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype(">u4").tobytes()).decode()


def share(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Likeness of two kept sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    distinct = np.concatenate(([True], ~twice))
    last = np.cumsum(distinct)  # number of distinct hashes up to here
    return float(np.count_nonzero(twice & (last[1:] <= keep)) / min(keep, last[-1]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """doc_id, n_chars, n_phrases and fingerprint of every row; narrow."""
    bound_arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [parse(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, made), pa.int64()), pa.array([encoded(smallest(p, keep)) for p in made], pa.string())],
                                             ["doc_id", "n_chars", "n_phrases", "fingerprint"])
        give_back()

    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("n_chars", LongType()), StructField("n_phrases", LongType()), StructField("fingerprint", StringType())]))


def likeness(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Likeness of two fingerprint columns; null where one is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        read = lambda s: np.frombuffer(base64.b64decode(s), ">u4").astype(np.uint32)
        return pd.Series([None if s is None or t is None else share(read(s), read(t), keep) for s, t in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(a, b)


def in_ranges(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int, most_ranges: int) -> DataFrame:
    """(range, guest, id, tie, t): the rows in ranges of (id, tie), one range a partition, in order; each range ends with a guest, the first row of the range after it (the last: of the first).

    The bounds are the first keys of range partitions of the keys alone: at most most_ranges of them reach the driver and every row's plan. Texts are shuffled once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = materialise(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie")))
    ranges = max(1, min(most_ranges, -(-keys.count() // rows_per_range)))
    dealt = keys.repartitionByRange(ranges, "id", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "tie")).alias("k"))
    bounds = [r[0] for r in dealt.orderBy("k").select("k").collect()]
    drop_written(keys)
    kind = docs.schema[id_col].dataType
    literal = lambda k: F.struct(F.lit(k[0]).cast(kind).alias("id"), F.lit(k[1]).alias("tie"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("t"))
    if not bounds:
        return rows.select(F.lit(0).alias("range"), F.lit(False).alias("guest"), "id", "tie", "t").limit(0)
    key = F.struct("id", "tie")
    block = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + block] for i in range(0, len(bounds), block)]
    upto = lambda x: x <= key
    rows = rows.withColumn("b", F.greatest(F.size(F.filter(F.array(*[literal(b[0]) for b in blocks]), upto)), F.lit(1)))
    inside = F.element_at(F.array(*[F.array(*[literal(k) for k in b]) for b in blocks]), F.col("b"))
    rows = rows.withColumns({"at": F.size(F.filter(inside, upto)), "head": F.exists(inside, lambda x: x == key)})
    rows = rows.withColumn("range", F.greatest((F.col("b") - 1) * block + F.col("at") - 1, F.lit(0)))
    before = F.when(F.col("range") == 0, len(bounds) - 1).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("range"), F.lit(True).alias("guest"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("head"), F.array(own, guest)).otherwise(F.array(own))))
    return rows.select("place.range", "place.guest", "id", "tie", "t").repartitionById(len(bounds), F.col("range")).sortWithinPartitions("guest", "id", "tie")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP, part: int = 4, rows_per_range: int = 1024, most_ranges: int = 4096) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // part code points replaced by as many first ones (or all) of the next row's text. What both texts begin with is parsed once."""
    bound_arrow_batches(docs.sparkSession)
    rows = in_ranges(docs, id_col, text_col, rows_per_range, most_ranges)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finished(data: bytes, text: str, phrases: list[bytes], kept: np.ndarray, after: tuple) -> tuple:
        cut = len(text) - len(text) // part
        start = text[:cut].encode()
        edited = start + after[1][: len(text) // part].encode()
        if edited == data:
            other = kept
        else:
            ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
            same = int(np.searchsorted(ends, len(start), "right"))  # these phrases were told by bytes that both texts have
            other = smallest(parse(edited, phrases[:same], int(ends[same - 1]) if same else 0), keep)
        return len(text), hashlib.sha256(edited).hexdigest(), encoded(kept), encoded(other), share(kept, other, keep), share(kept, after[0], keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = done = None  # the row before, which needs the one that follows
        for b in batches:
            ids, out = [], []
            for i, (guest, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                if done:
                    continue  # further guests are repeats of the first
                data = t.as_py()
                text = data.decode()
                phrases = parse(data)
                kept = smallest(phrases, keep)
                if waiting:
                    ids.append(waiting[0])
                    out.append(finished(*waiting[1:], (kept, text)))
                waiting, done = (b.column(1).slice(i, 1), data, text, phrases, kept), guest
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)
        give_back()

    types = [LongType(), StringType(), StringType(), StringType(), DoubleType(), DoubleType()]
    return rows.select("guest", "id", "t").mapInArrow(run, StructType([StructField("doc_id", docs.schema[id_col].dataType), *(StructField(n, k) for n, k in zip(names[1:], types))]))


def op13_phrase_fingerprint(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))
