"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence's score is sigmoid(b + sum of the weights of its distinct words in the vocabulary), 0 without such a word; a document's is
1 - (1 - leak) * product(1 - sentence score). Vocabulary: words much more frequent in toxic training documents, found with Spark over the training rows.
Training reads at most `sample` labelled rows (by hash of the id; rows of equal text once), never held-out ones (crc32(id) % 5 = 0); every whole text is scored.

Null and empty texts have no sentences and score the leak. Labels, lang, source and the id never enter a score. A text that rows of both labels hold, or an id with both, counts as toxic. Without labels of both
kinds every score is the share of toxic labels (0 if none). Rows repeating a doc_id are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, give_back, materialise, table

WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of at most `sample` labelled rows that are not held out."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").distinct().where(~held_out("doc_id"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")  # at most `sample` ids
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))
    return materialise(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample))


def choose_words(rows: DataFrame, most: int, least: int = 4) -> list[str]:
    """At most `most` words that toxic rows hold at least three times as often, by z of the log odds."""
    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    pos, neg = float(total[0]), float(total[1] - total[0])
    if not pos or not neg:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stats = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where(F.col("p") >= least)
    a, b = F.col("p") + 0.5, F.col("n") + 0.5
    odds = F.log(a / (pos + 1) / (b / (neg + 1)))
    stats = stats.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b)).where((F.col("odds") > np.log(3)) & (F.col("z") > 3.5))
    return [r[0] for r in stats.orderBy(F.desc("z"), "word").limit(most).collect()]


def sentence_hits(text: str | None, index: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """(start, stop, vocabulary numbers) of the sentences that hold a vocabulary word."""
    low = (text or "").lower()
    if index.keys().isdisjoint(WORDS.findall(low)):
        return []
    out = []
    for m in SENTENCE.finditer(text):
        found = sorted({index[w] for w in WORDS.findall(m[0].lower()) if w in index})
        if found:
            out.append((m.start(), m.end(), found))
    return out


def sentence_score(words: list[int], weights: np.ndarray, bias: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(bias + weights[words].sum(), -30, 30))))


def noisy_or(scores: list[float], leak: float) -> float:
    return float(1 - (1 - leak) * np.prod([1 - x for x in scores]))


def fit(bags: list[tuple[int, list[list[int]]]], n_words: int, steps: int = 400, rate: float = 0.1, ridge: float = 2e-4):
    """(weights, bias, leak) by full-batch Adam on the noisy-or likelihood. bags: (label, sentences)."""
    y = np.array([b[0] for b in bags], float)
    sentence_doc = np.array([d for d, b in enumerate(bags) for _ in b[1]], int)
    at = [(s, w) for s, words in enumerate(x for b in bags for x in b[1]) for w in words]
    s_of, w_of = (np.array(x, int) for x in (zip(*at) if at else ((), ())))
    theta = np.concatenate([np.full(n_words, 1.0), [-2.0, np.log(0.05 / 0.95)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + np.bincount(s_of, theta[w_of], len(sentence_doc)) if len(at) else np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-theta[-1]))
        clean = np.log1p(-leak) + np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        total = np.clip(-np.expm1(clean), 1e-9, 1)
        pull = np.where(y > 0, np.exp(clean) / total, -1.0)  # of log likelihood by a sentence's logit, over its p
        g = np.zeros_like(theta)
        gs = pull[sentence_doc] * p
        if len(at):
            g[:-2] = np.bincount(w_of, gs[s_of], n_words)
        g[-2], g[-1] = gs.sum(), (pull * leak).sum()
        g = g / len(y)
        g[:-2] -= ridge * theta[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_words: int = 2_000):
    """The model: vocabulary numbers, weights, bias, leak."""
    rows = training_rows(docs, labels, sample)
    words = choose_words(rows, most_words)
    index = {w: i for i, w in enumerate(words)}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "s": [[h[2] for h in sentence_hits(t, index)] for t in b["text"]]})

    got = rows.select("toxic", "text").mapInPandas(bags, "toxic int, s array<array<int>>").collect()  # at most `sample` short rows
    share = float(np.mean([r[0] for r in got])) if got else 0.0
    if not words:
        return {}, np.zeros(0), 0.0, share
    weights, bias, leak = fit([(r[0], r[1]) for r in got], len(words))
    return index, weights, bias, min(leak, 0.49)


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """doc_id, score, sentences (start, stop, score of those at or over `offending`; code points, stop not included)."""
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_words words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, weights, bias, leak = shared.value
        for b in batches:
            scores, places = [], []
            for t in b["t"]:
                hits = sentence_hits(t, index)
                p = [sentence_score(h[2], weights, bias) for h in hits]
                scores.append(noisy_or(p, leak))
                places.append([{"start": h[0], "stop": h[1], "score": float(x)} for h, x in zip(hits, p) if x >= offending])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "sentences": places})
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInPandas(
        run, "doc_id long, score double, sentences array<struct<start: int, stop: int, score: double>>")


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
