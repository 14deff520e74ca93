"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector kept per group.

Centres are fitted on a bounded sample (at most `sample` vectors of a length, by hash of the id, as 8 bytes a component on the driver); their number grows with the vectors, a cell for each
`cell_size`, at most `sample` / 8 over all lengths. Every vector is assigned to its home cell and visits some others.
The plane between the centres of two cells lies between the partners of a pair with homes there; two unit vectors of cosine t are r = sqrt(2 - 2t) apart, so the nearer one
is at most r / 2 from the plane. It is enough that this one visits the other's home. How far partners lie apart across a plane is measured, line by line between centres:
`probes` vectors of a length, chosen by hash, are compared with all vectors, and each one's farthest link gives an offset. The reach across a plane is half of `sigmas` times r times the share of
these offsets, or of the spread around the centres where that is more, along the line; r / 2, which loses no pair, is the most. Where that finds fewer than 99 % of the probes' farthest links, the reach is doubled, then r / 2.
Tests measure recall (of thousands of planted pairs, on data of low and full rank, with offsets along few axes); sigmas=None takes r / 2 everywhere, the exact join.

In a cell, blocks of its home vectors are multiplied by blocks of all its vectors, tile by tile; visitors are not compared with each other. A pair counts for both vectors, once: where each visits the other, in the lower cell.
Tasks return link counts and a spanning forest, never the pairs. Equal vectors are joined first and count by their number.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths never link.
Null ids are passed through without links. Repeated rows count as separate vectors. Labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, components, give_back, materialise, table
from .jaccard_join import by_group, roots

TILE = 1024
BLOCK_BYTES = 4 << 20
FITTED_LENGTHS = 16  # vector lengths that get centres of their own, most frequent first; those of other lengths are one cell each


def _units(arrays, dim: int) -> np.ndarray:
    x = np.array([a for a in arrays], dtype=np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def fit_centres(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means on unit vectors: centres of unit length."""
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return np.unique(c, axis=0)


def gaps(c: np.ndarray) -> np.ndarray:
    """Distances between centres."""
    return np.array([np.linalg.norm(c - one, axis=1) for one in c])


def shares(steps: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean square of unit steps along the line between any two centres; the length of a step does not count, steps of none are left out."""
    size = np.linalg.norm(steps, axis=1)
    steps = steps[size > 1e-9] / size[size > 1e-9, None]
    if not len(steps):
        return np.zeros((len(c), len(c)))
    value, vector = np.linalg.eigh(steps.T @ steps / len(steps))
    return (gaps(c @ (vector * np.sqrt(np.maximum(value, 0)))) / np.maximum(gaps(c), 1e-12)) ** 2


def limits(x: np.ndarray, links: tuple[np.ndarray, np.ndarray], c: np.ndarray, apart: float, sigmas: float | None, target: float = 0.99) -> np.ndarray:
    """How much nearer, as a difference of dot products, the vectors of a cell may be to its centre than to another one whose cell they still visit. links: the probes and their farthest links."""
    if sigmas is not None and len(c) > 1:
        a, b = links
        share = np.sqrt(np.maximum(shares(x - c[np.argmax(x @ c.T, axis=1)], c), shares(b - a, c)))
        for wide in (sigmas, 2 * sigmas):
            most = np.minimum(apart / 2 + 1e-6, wide * apart * share / 2) * gaps(c)
            (ha, ia), (hb, ib) = visits(a, c, most), visits(b, c, most)
            row = np.arange(len(a))
            if not len(a) or (ia[row, hb] | ib[row, ha]).mean() >= target:
                return most
    return (apart / 2 + 1e-6) * gaps(c)


def visits(x: np.ndarray, c: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and which cells it is in."""
    dots = x @ c.T
    home = np.argmax(dots, axis=1) if len(x) else np.zeros(0, int)
    row = np.arange(len(x))
    into = dots[row, home][:, None] - dots <= most[home]
    into[row, home] = True
    return home, into


def _collected(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of rows (id, vector of length dim), collected as Arrow columns."""
    found = rows.toArrow()
    v = found.column(1).combine_chunks()
    return found.column(0).to_numpy().astype(np.int64), _units(np.asarray(v.flatten(), np.float64).reshape(-1, dim), dim) if len(v) else np.empty((0, dim))


def farthest_links(groups: DataFrame, model: dict, threshold: float) -> DataFrame:
    """Rows (dim, probe, x) of the farthest link, if any, of each probe, a row of model[dim] = (ids, unit vectors), among all other vectors."""
    shared = groups.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby("dim"):
                if dim not in shared.value:
                    continue
                ids, probes = shared.value[dim]
                for start in range(0, len(b), 1024):
                    part = b.iloc[start : start + 1024]
                    x = _units(part["v"], dim)
                    dots = probes @ x.T
                    dots[(dots < threshold) | (ids[:, None] == part["rep"].to_numpy()[None, :])] = 2.0
                    at = dots.argmin(1)
                    hit = np.nonzero(dots[np.arange(len(ids)), at] < 2.0)[0]
                    if len(hit):
                        yield pd.DataFrame({"dim": np.full(len(hit), dim), "probe": ids[hit], "dot": dots[hit, at[hit]], "rep": part["rep"].to_numpy()[at[hit]], "x": list(x[at[hit]])})
        give_back()

    found = groups.select("dim", "rep", "v").mapInPandas(run, "dim int, probe long, dot double, rep long, x array<double>")
    return found.groupBy("dim", "probe").agg(F.min(F.struct("dot", "rep", "x")).alias("far")).select("dim", "probe", "far.x")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    sample: int = 20_000, rounds: int = 6, cell_size: int = 1024, seed: int = 7, sigmas: float | None = 3.0, probes: int = 1024) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad, v).alias("v"))
    valid = rows.where("v IS NOT NULL AND vec_id IS NOT NULL")
    # Equal vectors: by a hash of all components and the vector itself
    groups = materialise(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")).withColumn("dim", F.size("v")))
    apart = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    lengths = groups.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(FITTED_LENGTHS).collect()
    every = sum(n for _, n in lengths)
    fitted, asked = {}, {}
    for dim, n in lengths:
        cells = int(max(1, min(n // cell_size, sample // 8 * n // every)))
        own = groups.where(F.col("dim") == dim).orderBy(F.xxhash64("rep", F.lit(seed)))
        ids, x = _collected(own.limit(min(sample, max(4_000, 32 * cells))).select("rep", "v"), dim)
        fitted[dim] = (x, fit_centres(x, cells, rounds))
        if sigmas is not None and len(fitted[dim][1]) > 1:
            asked[dim] = (ids[:probes], x[:probes])
    far = materialise(farthest_links(groups, asked, threshold)) if asked else None
    model = {}  # by vector length: centres, and limits of visits from each cell to each other one
    for dim, (x, c) in fitted.items():
        links = (np.empty((0, dim)), np.empty((0, dim)))
        if dim in asked:
            ids, b = _collected(far.where(F.col("dim") == dim).select("probe", "x"), dim)
            order = np.argsort(asked[dim][0])
            links = (asked[dim][1][order[np.searchsorted(asked[dim][0][order], ids)]], b)
        model[dim] = (c, limits(x, links, c, apart, sigmas))
    shared = spark.sparkContext.broadcast(model)  # at most sample / 8 centres, and the square of that of limits: 50 MB

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby("dim"):
                for start in range(0, len(b), 1024):
                    part = b.iloc[start : start + 1024]
                    x = _units(part["v"], dim)
                    if dim in shared.value:
                        home, into = visits(x, *shared.value[dim])
                    else:
                        home, into = np.zeros(len(x), int), np.ones((len(x), 1), bool)
                    yield pd.DataFrame({"dim": part["dim"], "rep": part["rep"], "members": part["members"], "home": home, "cells": [np.nonzero(i)[0] for i in into], "x": [one.tobytes() for one in x]})
        give_back()

    placed = materialise(groups.select("dim", "rep", "members", "v").mapInPandas(place, "dim int, rep long, members long, home int, cells array<int>, x binary"))
    lie = placed.withColumn("cell", F.explode("cells"))
    most = F.greatest(F.lit(TILE), F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
    blocks = materialise(lie.groupBy("dim", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("h"), F.count("*").alias("n")).where("h > 0").select(
        "dim", "cell", F.ceil(F.col("h") / most).cast("int").alias("rows"), F.ceil(F.col("n") / most).cast("int").alias("columns")))
    # Home vectors as rows of a product with each block of columns, all vectors of the cell as columns with each block of rows
    part = lambda n: F.pmod(F.xxhash64("rep", "cell"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    told = lie.join(blocks, ["dim", "cell"])
    as_rows = F.when(F.col("home") == F.col("cell"), F.transform(upto("columns"), lambda q: F.struct(F.lit(True).alias("left"), part("rows").alias("p"), q.alias("q"))))
    as_columns = F.transform(upto("rows"), lambda p: F.struct(F.lit(False).alias("left"), p.alias("p"), part("columns").alias("q")))
    sent = told.withColumn("to", F.explode(F.concat(as_columns, F.coalesce(as_rows, F.array().cast("array<struct<left:boolean,p:int,q:int>>"))))).select(
        "dim", "cell", "to.p", "to.q", "to.left", "home", "cells", "rep", "members", "x")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        dim, cell = rows["dim"].iloc[0], rows["cell"].iloc[0]
        sides = []
        for d in (rows[rows["left"]], rows[~rows["left"]]):
            cells = d["cells"].to_numpy()
            seen = np.repeat(np.arange(len(d)), [len(k) for k in cells]) << 32 | np.concatenate([*cells, np.empty(0, np.int64)]).astype(np.int64)
            sides.append((np.frombuffer(b"".join(d["x"]), np.float64).reshape(len(d), dim), d["rep"].to_numpy(), d["members"].to_numpy(), d["home"].to_numpy(np.int64), seen))
        (x, ia, ma, _, sa), (y, ib, mb, hb, _) = sides
        la, lb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        out = [(np.empty(0, np.int64),) * 3]
        for i in range(0, len(ia), TILE):
            for j in range(0, len(ib), TILE):
                s, t = np.nonzero(x[i : i + TILE] @ y[j : j + TILE].T >= threshold)
                s, t = s + i, t + j
                # Home pairs in order of their ids; a pair with homes in two cells that each visit the other's in the lower cell
                keep = np.where(hb[t] == cell, ia[s] < ib[t], (hb[t] > cell) | ~np.isin(s << 32 | hb[t], sa))
                s, t = s[keep], t[keep]
                if not len(s):
                    continue
                la += np.bincount(s, mb[t], len(la)).astype(np.int64)
                lb += np.bincount(t, ma[s], len(lb)).astype(np.int64)
                us, ut = np.unique(s), np.unique(t)
                both = np.zeros((len(us) + len(ut),) * 2, bool)  # a square matrix over both sides gives the forest
                both[np.searchsorted(us, s), len(us) + np.searchsorted(ut, t)] = True
                both |= both.T
                ids = np.concatenate([ia[us], ib[ut]])
                out.append((ids, ids[roots(both)], np.zeros(len(ids), np.int64)))
        for ids, links in ((ia, la), (ib, lb)):
            out.append((ids[links > 0], ids[links > 0], links[links > 0]))
        return pd.DataFrame(dict(zip(("rep", "root", "links"), map(np.concatenate, zip(*out)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_group(["dim", "cell", "p", "q"], compare, batches)
        give_back()

    keys = ("dim", "cell", "p", "q")
    linked = materialise(sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "rep long, root long, links long"))
    comp = materialise(components(linked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    total = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = groups.select("v", "rep", "members").join(total, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("v").alias("w"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component"))
    out = rows.join(materialise(known), F.col("v") == F.col("w"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                                              F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN k USING (vec_id)
"""


def op7_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
