"""Quality classifier by co-training: a view of the text and a view of the page's metadata.

Text view: shares of kinds of characters, repetition, word and line lengths, and the words themselves, hashed into slots, from the whole text. Metadata view: lang and source (hashed
into a few slots) and length. Each view is a ridge logistic regression. In every round each scores all documents that have no label in Spark, and its most
confident ones (2 * `give`, in the proportion of the labels' classes, those it is `sure` of by odds calibrated on held-out folds) become pseudo-labels of the other. Both are
then calibrated: a logistic regression joins their log odds on the labels, each from a model that has not seen the row's fold. All rounds run; the models of the round whose
joint loss on held-out folds is least, no round included, rate all documents.

At most `sample` labelled rows (by hash of the id) are read for fitting, and `give` documents a class, view and round; all else covers all rows and whole texts.
Null texts count as empty, null lang, source or n_chars are values of their own. Without labels of both kinds every score is 1 and nothing is rejected. Repeated label rows count
once per (id, label); rows repeating a doc_id are scored by their own text and columns, and kept or dropped one by one. A column of documents named like an output is not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, drop_written, give_back, materialise, row_key, table, without_rows
from .jaccard_join import WordHashes

WORD_SLOTS, META_SIZE, SLOTS = 192, 42, 32
ROWS = 4096  # of a design matrix that are standardised at once
KINDS = np.zeros(256, int)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop, 7 bang, 8 pipe, 9 odd sign, 10 beyond ASCII
KINDS[128:] = 10
for _kind, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\r"), (5, b"\n"), (6, b".,;:?'\"()-"), (7, b"!"), (8, b"|"), (9, b"#$%&*@<>=+/\\^_`{}[]~")):
    KINDS[list(_chars)] = _kind


def text_view(text: str | None, hashes: WordHashes) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kinds = np.bincount(KINDS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=11) / n
    words = raw.lower().split()
    lines = raw.split(b"\n")
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    slots = np.sqrt(np.bincount((found % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS) / max(1, len(words)))
    distinct = len(np.unique(found)) / max(1, len(words))
    return np.concatenate([kinds, [distinct, distinct * np.log1p(len(words)), len(set(lines)) / len(lines), (n / max(1, len(words))) ** 0.5, np.log1p(n / len(lines))], slots])


def meta_view(lang, source, n_chars) -> list[float]:
    out = [0.0] * META_SIZE
    out[xxhash.xxh32_intdigest(f"l{lang}") % 8] = 1.0
    out[8 + xxhash.xxh32_intdigest(f"s{source}") % SLOTS] = 1.0
    known = not pd.isna(n_chars)
    out[-2], out[-1] = (float(np.log1p(max(0, n_chars))) if known else 0.0), float(not known)
    return out


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the row), a, b: the two views of every row, as bytes of 32-bit floats."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "a": [text_view(t, hashes).astype(np.float32).tobytes() for t in b["t"]],
                                "b": [np.array(meta_view(*x), np.float32).tobytes() for x in zip(b["lang"], b["source"], b["n_chars"])]})
        del hashes
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("t"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars")).mapInPandas(
        run, "doc_id long, key string, a binary, b binary")


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns; the rows are standardised block by block, so that memory holds x and little more."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0, dtype=float), x.std(0, dtype=float)
        self.scale[self.scale < 1e-9] = np.inf
        weight = np.ones(len(y)) if weight is None else weight
        size = x.shape[1] + 1
        self.w = np.zeros(size)
        penalty = np.full(size, ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            gram, pull = np.diag(penalty) + 1e-9 * np.eye(size), -penalty * self.w
            for at in range(0, len(y), ROWS):
                here = slice(at, at + ROWS)
                z = self._z(x[here])
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                gram += (z * (weight[here] * p * (1 - p))[:, None]).T @ z
                pull += z.T @ (weight[here] * (y[here] - p))
            step = np.linalg.solve(gram, pull)
            self.w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *[np.clip(self._z(x[at : at + ROWS]) @ self.w, -30, 30) for at in range(0, len(x), ROWS)]])


def fit_view(x: np.ndarray, y: np.ndarray, given: tuple[np.ndarray, np.ndarray], rows=slice(None)) -> Logistic:
    """A view's model from labelled rows and the pseudo-labels it was given, which weigh half. They are standardised together."""
    gx, gy = given
    return Logistic(np.vstack([x[rows], gx]), np.concatenate([y[rows], gy]), np.concatenate([np.ones(len(y[rows])), np.full(len(gy), 0.5)]))


def held_out(a: np.ndarray, b: np.ndarray, y: np.ndarray, given_a, given_b, folds: np.ndarray) -> np.ndarray:
    """Log odds of each row by both views' models that were fitted without the row's fold."""
    odds = np.zeros((len(y), 2))
    for f in np.unique(folds):
        rest, here = folds != f, folds == f
        if len(np.unique(y[rest])) < 2:
            rest = np.ones(len(y), bool)
        odds[here, 0] = fit_view(a, y, given_a, rest).logit(a[here])
        odds[here, 1] = fit_view(b, y, given_b, rest).logit(b[here])
    return odds


def calibrate(a: np.ndarray, b: np.ndarray, y: np.ndarray, given_a, given_b, folds: np.ndarray) -> Logistic:
    """The joint model, from log odds of each row by models that were fitted without the row's fold."""
    return Logistic(held_out(a, b, y, given_a, given_b, folds), y)


def log_loss(joint: Logistic, odds: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * joint.logit(odds)).mean())


class Calibrated:
    """A view whose log odds are put right by a regression on held-out ones, so that being sure is being right that often; a view that knows nothing is sure of nothing."""

    def __init__(self, view: Logistic, odds: np.ndarray, y: np.ndarray):
        self.view, self.mean, self.put_right = view, view.mean, Logistic(odds[:, None], y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.put_right.logit(self.view.logit(x)[:, None])


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, size)


def _scored(seen: DataFrame, models) -> DataFrame:
    """doc_id, key, p_text, p_meta (and score, with a joint model) of rows of views()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, meta, joint = models
        p = lambda z: 1 / (1 + np.exp(-z))
        for batch in batches:
            if len(batch):
                a, b = text.logit(_matrix(batch["a"], len(text.mean))), meta.logit(_matrix(batch["b"], len(meta.mean)))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "p_text": p(a), "p_meta": p(b),
                                    "score": p(joint.logit(np.stack([a, b], 1))) if joint else 0.0})

    return seen.mapInPandas(run, "doc_id long, key string, p_text double, p_meta double, score double")


def pseudo_labels(scored: DataFrame, giver: str, give: int, sure: float, share: float = 0.5) -> DataFrame:
    """key, label: the documents that a view is most sure of, at most 2 * give, of these the share of the good. Ties go by hash of the key."""
    p, good = F.col(giver), round(2 * give * share)
    ends = [scored.where(p >= sure).orderBy(F.desc(giver), F.xxhash64("key"), "key").limit(good).select("key", F.lit(1.0).alias("label")),
            scored.where(p <= 1 - sure).orderBy(F.asc(giver), F.xxhash64("key"), "key").limit(2 * give - good).select("key", F.lit(0.0).alias("label"))]
    return ends[0].unionByName(ends[1])


def train(seen: DataFrame, labels: DataFrame, sample: int = 20_000, rounds: int = 2, give: int = 500, sure: float = 0.97, n_folds: int = 3):
    """The three models from views() of all documents, written; None without labels of both kinds."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    got = seen.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "key").limit(sample).select("doc_id", "quality", "a", "b").toPandas()
    a, b, y = _matrix(got["a"], 16 + WORD_SLOTS), _matrix(got["b"], META_SIZE), got["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    none = lambda x: (np.empty((0, x.shape[1]), np.float32), np.empty(0))
    given = {"a": none(a), "b": none(b)}
    text, meta = fit_view(a, y, given["a"]), fit_view(b, y, given["b"])
    folds = np.array([xxhash.xxh32_intdigest(str(i)) % n_folds for i in got["doc_id"]])
    odds = held_out(a, b, y, given["a"], given["b"], folds)
    joint = Logistic(odds, y)
    best = (log_loss(joint, odds, y), text, meta, joint)
    labelled = known.select("doc_id").distinct()
    taken: dict[str, set[str]] = {"a": set(), "b": set()}
    for _ in range(rounds):
        scored = materialise(_scored(seen, (Calibrated(text, odds[:, 0], y), Calibrated(meta, odds[:, 1], y), None)).join(labelled, "doc_id", "left_anti"))
        for giver, to in (("p_text", "b"), ("p_meta", "a")):
            told = {r[0]: r[1] for r in pseudo_labels(scored, giver, give, sure, float(y.mean())).collect() if r[0] not in taken[to]}  # at most 2 * give
            if not told:
                continue
            keys = seen.sparkSession.createDataFrame(list(told.items()), "key string, label double")
            rows = seen.join(F.broadcast(keys), "key").dropDuplicates(["key"]).orderBy("key").select("key", to, "label").toPandas()
            x, label = given[to]
            given[to] = (np.vstack([x, _matrix(rows[to], x.shape[1])]), np.concatenate([label, rows["label"].to_numpy(float)]))
            taken[to] |= set(rows["key"])
        drop_written(scored)
        text, meta = fit_view(a, y, given["a"]), fit_view(b, y, given["b"])
        odds = held_out(a, b, y, given["a"], given["b"], folds)
        joint = Logistic(odds, y)
        best = min(best, (log_loss(joint, odds, y), text, meta, joint), key=lambda x: x[0])
    return best[1:]


def score_documents(seen: DataFrame, models) -> DataFrame:
    """doc_id, key, p_text, p_meta, score: chances of good quality, of rows of views()."""
    if models is None:
        return seen.select("doc_id", "key", *[F.lit(1.0).alias(x) for x in ("p_text", "p_meta", "score")])
    return _scored(seen, models)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    seen = materialise(views(docs))
    bad = score_documents(seen, train(seen, labels)).where(F.col("score") < least)
    return without_rows(docs, bad, "doc_id", "text")


def op6_quality(spark, sf_dir):
    seen = materialise(views(table(spark, sf_dir, "documents")))
    scored = score_documents(seen, train(seen, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
