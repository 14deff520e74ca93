"""Token counts: greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a model file's pieces (a parameter): those that begin with U+2581 start a word, the others go on inside one. Every word (run without
white space) is cut greedily into longest pieces; a word that cannot be cut whole is one unknown token. The automaton is the pieces' trie with
failure links; a node's link carries how many pieces it pops, so a word's count is a sum over its characters and no piece is built.

Null text gives null counts, an empty text zeros. Repeated rows are counted alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, give_back, table
from .sentencepiece_dropout import MODEL, SPACE, pieces


class Automaton:
    def __init__(self, vocabulary):
        self.child: dict[tuple[int, str], int] = {}
        parent, edge, word = [-1], [""], [False]
        depth: list[list[int]] = [[0]]
        for piece in vocabulary:
            node = 0
            for d, c in enumerate(piece, 1):
                to = self.child.get((node, c))
                if to is None:
                    to = self.child[node, c] = len(parent)
                    parent.append(node)
                    edge.append(c)
                    word.append(False)
                    if len(depth) == d:
                        depth.append([])
                    depth[d].append(to)
                node = to
            word[node] = True
        self.link, self.pops = [-1] * len(parent), [0] * len(parent)
        for level in depth[1:]:
            for v in level:
                if word[v]:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.link[parent[v]], self.pops[parent[v]]
                while z >= 0 and (z, edge[v]) not in self.child:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.child[z, edge[v]], popped

    def count(self, word: str) -> int:
        """Pieces of a word, 0 when it cannot be cut."""
        node = total = 0
        for c in word:
            while (to := self.child.get((node, c))) is None:
                total += self.pops[node]
                node = self.link[node]
                if node < 0:
                    return 0
            node = to
        while node:
            total += self.pops[node]
            node = self.link[node]
            if node < 0:
                return 0
        return total


class Counts(dict):
    def __init__(self, model: str, keep: int):
        self.automaton, self.keep = Automaton(pieces(model).id), keep

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(SPACE + word)
        if len(word) <= 48:
            if len(self) >= self.keep:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, keep: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_unknown, n_tokens (unknown words count 1) per row."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(model, keep)
        for b in batches:
            rows = []
            for t in b["t"]:
                found = None if t is None else list(map(counts.__getitem__, t.split()))
                unknown = found and found.count(0)
                rows.append((None,) * 3 if found is None else (len(found), unknown or 0, sum(found) + (unknown or 0)))
            out = pd.DataFrame(rows, columns=["n_words", "n_unknown", "n_tokens"]).astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out
        del counts
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInPandas(
        run, "doc_id long, n_words long, n_unknown long, n_tokens long")


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
