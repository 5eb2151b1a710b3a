"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with escape probabilities (method C), learned from a bounded sample
of labelled texts and then frozen. A text's exact code length under each tree is the sum over its lower-cased words, whose
contexts begin at the word's start; the language of the shortest code is predicted. As a word always has the same length
under frozen statistics, workers keep the lengths of words that they have seen.

A very long text is scored whole; what is held for it is its words. Rows that repeat come out as often as they come in, each with the same result; tables without rows give none; further
columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.bytetree import START, STOP, Scorer, Tree, counts_of
from rowloom.llm.common import map_arrow, picked

#: Words whose code lengths a worker keeps; it starts anew beyond that.
KEPT_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def train(labelled: DataFrame, per_language: int = 300, depth: int = 4) -> dict[str, Tree]:
    """Trees from at most per_language texts of each language, which a hash of the text and id picks; null texts and languages are left out.

    labelled: (doc_id, text, lang). per_language bounds what reaches the driver.
    """
    rows = picked(labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang"), "lang", F.xxhash64("doc_id", "text"), "doc_id", per_language)
    counts: dict[str, Counter] = {}
    for row in rows.select("lang", "text").collect():
        counts.setdefault(row["lang"], Counter()).update(words_of(row["text"]))
    return {lang: Tree.ppm(*counts_of([START] * len(c), [w + STOP for w in c], np.array(list(c.values())), depth), depth) for lang, c in sorted(counts.items())}


class _Lengths:
    """Natural log probabilities of words under each tree."""

    def __init__(self, trees: list[Tree]):
        self.scorer = Scorer(trees)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.scorer.trees)), np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if new:
            at = len(self.known)
            while at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(new)] = self.scorer.score([START] * len(new), [w + STOP for w in new])
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def identify(docs: DataFrame, trees: dict[str, Tree], *more: Column) -> DataFrame:
    """(doc_id, more, lang_pred, score) for each row: score is the predicted language's share of the trees' probabilities.

    A null text, or one without a letter, gets `und` and score 0, as does every text if no language was learned.
    Ties go to the first language in alphabetical order.
    """
    langs = sorted(trees)
    shipped = docs.sparkSession.sparkContext.broadcast([trees[x] for x in langs])
    frame = docs.select("doc_id", *more, docs["text"].alias("__text"))
    n = len(frame.columns) - 1
    names = [*frame.columns[:n], "lang_pred", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(shipped.value)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            # several texts at once, so that new words are scored together
            groups, weight = [[]], 0
            for k, text in enumerate(texts):
                weight += len(text or "")
                if weight > 4_000_000:
                    groups.append([])
                    weight = 0
                groups[-1].append(k)
            best, share = ["und"] * len(texts), np.zeros(len(texts))
            for group in groups:
                if not langs:
                    break
                lists = [words_of(texts[k]) for k in group]
                if len(lengths.known) > KEPT_WORDS:
                    lengths.clear()
                rows = lengths.rows([w for x in lists for w in x])
                at = 0
                for k, words in zip(group, lists, strict=True):
                    total = rows[at : at + len(words)].sum(axis=0, dtype=float)
                    at += len(words)
                    if words and any(map(str.isalpha, texts[k])):
                        winner = int(np.argmax(total))
                        best[k], share[k] = langs[winner], 1 / np.exp(total - total[winner]).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(best), pa.array(share)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:n])
    return map_arrow(frame, work, f"{fields}, lang_pred string, score double")
