"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

Terms are words and their first 3 to 8 characters; a bounded sample of labelled rows
says which terms tell the labels apart, in either direction. Examples are indexed by term in blocks of
neighbouring examples with the largest weight of each; blocks are visited by falling
bound until none can reach the k-th best. Votes weigh by similarity and are calibrated
on votes that leave each example itself out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rostrum.session import durable

SAMPLE_ROWS = 8192  # labelled rows that terms, examples and calibration come from
TERMS = 2048
LEAST_ROWS = 5  # of the sample that hold a term
NEIGHBOURS = 32
BLOCK = 64
CHUNK = 16  # blocks scored first, then four times as many
SLIP = 1e-9  # sums that differ by rounding only count as equal until the last
PRIOR_WEIGHT = 0.5  # of one more vote that holds the sample's share of label 1
BEGINNINGS = range(3, 9)
WORD = re.compile(r"\w+")
BATCH = 256
MOST_WORDS = 1 << 17
LONGEST_WORD = 64  # beyond, a word has only its beginnings, no term of its own


def terms_of(word: str) -> set[str]:
    """The word, and its beginnings with a mark: one stem has many endings."""
    out = {word} if len(word) <= LONGEST_WORD else set()
    out.update("^" + word[:n] for n in BEGINNINGS if n < len(word))
    return out


class Counts(dict):
    """Word to the positions of its terms in the vocabulary; remembers words."""

    def __init__(self, vocabulary: list[str]):
        self.at = {t: i for i, t in enumerate(vocabulary)}
        self.heads = {t.lstrip("^")[:BEGINNINGS.start] for t in vocabulary}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = ()
        if word[:BEGINNINGS.start] in self.heads:  # as the word and its beginnings start alike
            found = tuple(sorted(self.at[t] for t in terms_of(word) if t in self.at))
        if len(self) < MOST_WORDS and len(word) <= LONGEST_WORD:
            self[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and counts of the vocabulary's terms in a text."""
        held = chain.from_iterable(map(self.__getitem__, WORD.findall((text or "").lower())))
        n = np.bincount(np.fromiter(held, np.int64), minlength=1)
        keys = np.flatnonzero(n)
        return keys, n[keys].astype(float)


@dataclass
class Index:
    """Examples by term. `start[t, b]` is where term t's postings of block b begin."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    posting: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = np.log1p(counts) * self.idf[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, own: int | None = None
                ) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, ties to the smaller id.
        Examples without a common term, and `own`, take no part."""
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        starts = self.start[terms]
        best, cosine, least = np.empty(0, np.int64), np.empty(0), 0.0
        at, step = 0, CHUNK
        while at < len(order):
            blocks = order[at:at + step]
            blocks = blocks[bound[blocks] >= least - SLIP]
            if not len(blocks):
                break
            at, step = at + step, step * 4  # what the first blocks leave is mostly ruled out
            first = starts[:, blocks]
            size = starts[:, blocks + 1] - first
            weight = np.repeat(weights, size.sum(axis=1))
            first, size = first.ravel(), size.ravel()
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
            score = np.bincount(self.posting[place], self.weight[place] * weight)
            found = np.flatnonzero(score >= least - SLIP if least else score)  # weights are above 0
            if own is not None:
                found = found[self.ids[found] != own]
            best, cosine = np.concatenate([best, found]), np.concatenate([cosine, score[found]])
            if len(best) > k:
                least = float(np.partition(cosine, len(cosine) - k)[len(cosine) - k])
                near = cosine >= least - SLIP
                best, cosine = best[near], cosine[near]
        top = np.lexsort((self.ids[best], -np.round(cosine, 12)))[:k]
        return best[top], cosine[top]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * cosine
        return float(((w * self.labels[found]).sum() + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, vote: float) -> float:
        x = self.slope * _logit(vote) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def build(ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]],
          idf: np.ndarray, k: int = NEIGHBOURS) -> Index:
    """Index the examples. They are put in order of their heaviest term, so a block's
    examples resemble each other and its bounds are tight."""
    prior = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.5
    index = Index(idf, ids, labels, None, None, None, None, prior)
    units = [index.unit(*v) for v in vectors]
    key = [int(t[np.argmax(u)]) if len(u) else -1 for (t, _), u in zip(vectors, units)]
    order = np.lexsort((ids, key)) if len(ids) else np.empty(0, np.int64)
    index.ids, index.labels = ids[order], labels[order]
    blocks = max(1, -(-len(ids) // BLOCK))
    cells = [(t, i, w) for i, o in enumerate(order) for t, w in zip(vectors[o][0], units[o])]
    terms = np.array([c[0] for c in cells], np.int64)
    at = np.array([c[1] for c in cells], np.int64)
    weight = np.array([c[2] for c in cells], float)
    sort = np.lexsort((at, terms))
    terms, index.posting, index.weight = terms[sort], at[sort], weight[sort]
    cell = terms * blocks + index.posting // BLOCK
    index.start = np.searchsorted(
        cell, np.arange(len(idf))[:, None] * blocks + np.arange(blocks + 1)[None, :]
    )
    index.most = np.zeros((len(idf), blocks))
    np.maximum.at(index.most, (terms, index.posting // BLOCK), index.weight)
    votes = np.array([
        index.vote(*index.nearest(vectors[o][0], units[o], k, own=int(ids[o]))) for o in order
    ])
    index.slope, index.shift = _calibrate(votes, index.labels)
    return index


def _calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the vote's logit, lightly bound to (1, 0)."""
    x, b = _logit(votes), np.array([1.0, 0.0])
    for _ in range(50):
        if not len(x):
            break
        p = 1 / (1 + np.exp(-np.clip(b[0] * x + b[1], -500, 500)))
        w = p * (1 - p)
        grad = np.array([((p - labels) * x).sum(), (p - labels).sum()]) + (b - [1.0, 0.0])
        curve = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + np.eye(2)
        step = np.linalg.solve(curve, grad)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled documents `(id, text, y)`, by hash of the id. `labels`: id
    and 0/1; an id labelled twice takes the larger, one without a label none. Of an id's
    different texts the least counts, so a repeated id is one row."""
    key, mark = labels.columns
    known = labels.where(F.col(key).isNotNull() & F.col(mark).isNotNull()).groupBy(
        F.col(key).alias("id")
    ).agg(F.max(mark).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    doc, text = docs.columns
    return docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "id"  # `rows` at most
    ).groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def choose_terms(sample: DataFrame, terms: int = TERMS) -> list[str]:
    """The terms that tell label 1 from 0 best by chi-square over the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_1, with_0 = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set().union(*map(terms_of, set(WORD.findall((text or "").lower()))))
                (with_1 if y else with_0).update(found)
        names = list(with_1 | with_0)
        for at in range(0, len(names), 1 << 16):
            part = names[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.string()), pa.array([with_1[t] for t in part], pa.int64()),
                pa.array([with_0[t] for t in part], pa.int64()),
            ], ["term", "a", "b"])

    sizes = sample.agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("n1"), F.count(F.when(F.col("y") == 0, 1)).alias("n0")
    ).first()
    n1, n0 = float(sizes["n1"]), float(sizes["n0"])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    gap = a * (n0 - b) - b * (n1 - a)
    chi = F.try_divide(gap * gap, (a + b) * (n1 + n0 - a - b))
    counted = sample.select("text", "y").mapInArrow(count, "term string, a bigint, b bigint").groupBy(
        "term"
    ).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counted.where(a + b >= LEAST_ROWS).select("term", chi.alias("chi")).orderBy(
        F.desc_nulls_last("chi"), "term"
    ).limit(terms)
    return sorted(r["term"] for r in best.collect())


def vectors_of(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """`(id, terms, counts)` of `docs` (id and text): the terms each text holds, by number,
    and how often. Null, empty and unknown texts hold none. Further columns pass through."""
    key, text, *more = docs.columns
    rows = docs.select(F.col(text).alias("text"), F.col(key).cast("bigint").alias("id"), *more)
    cells = {"terms": "array<int>", "counts": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                held = [counts(t) for t in batch.column(0).to_pylist()]
                ends = np.cumsum([0] + [len(t) for t, _ in held]).astype(np.int32)
                parts = [
                    pa.ListArray.from_arrays(ends, np.concatenate([h[i] for h in held]).astype(np.int32))
                    for i in range(2)
                ] if held else [pa.array([], pa.list_(pa.int32()))] * 2
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], *parts], [*batch.schema.names[1:], *cells]
                )

    shape = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    shape += [f"{name} {kind}" for name, kind in cells.items()]
    return rows.mapInArrow(run, ", ".join(shape))


def inverse_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """The terms' weights from the rows of `vectors` that hold each: one row per term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms + 1, np.int64)  # the last: all rows
        for batch in batches:
            held[:-1] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
            held[-1] += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], ["at", "n"])

    sums = vectors.select("terms").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    held = np.zeros(terms + 1, np.int64)
    for r in sums.collect():
        held[r["at"]] = r["n"]
    return np.log((1 + held[-1]) / (1 + held[:-1])) + 1


def _index(sample: DataFrame, vocabulary: list[str], vectors: DataFrame, k: int) -> Index:
    """Index the sample; `vectors` are those of all documents."""
    got = vectors_of(sample, vocabulary).orderBy("id", "terms", "counts").collect()  # a bounded sample
    # Copies of a text are one example, which has the least id and the mean of their labels.
    same: dict[tuple, list] = {}
    for r in got:
        same.setdefault((tuple(r["terms"]), tuple(r["counts"])) if r["terms"] else r["id"], []).append(r)
    return build(
        np.array([rows[0]["id"] for rows in same.values()], np.int64),
        np.array([np.mean([r["y"] for r in rows]) for rows in same.values()]),
        [(np.array(rows[0]["terms"], np.int64), np.array(rows[0]["counts"], float))
         for rows in same.values()], inverse_frequencies(vectors, len(vocabulary)), k,
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = TERMS,
        k: int = NEIGHBOURS) -> tuple[list[str], Index]:
    """Vocabulary and index. `docs`: id and text; `labels`: id and 0/1. The sample is
    bounded by `rows`; document frequencies count all of `docs`, texts that are null or
    repeat included. Without labels or documents the index is empty."""
    sample = sample_of(docs, labels, rows)
    vocabulary = choose_terms(sample, terms)
    return vocabulary, _index(sample, vocabulary, vectors_of(docs, vocabulary), k)


def fit_score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = TERMS,
              k: int = NEIGHBOURS) -> DataFrame:
    """`score` of `docs` by what `fit` learns from them and `labels`. Texts are read for
    their terms once: these are written, then counted and scored."""
    sample = durable(sample_of(docs, labels, rows), "sample")  # `rows` at most, read four times
    vocabulary = choose_terms(sample, terms)
    vectors = durable(vectors_of(docs, vocabulary), "terms")
    index = _index(sample, vocabulary, vectors, k)
    # Small rows, much work: as many tasks as there were for the texts.
    return score_vectors(vectors.repartition(max(1, len(vectors.inputFiles()))), index, k)


def score(docs: DataFrame, vocabulary: list[str], index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """`(id, score, predicted, evidence)` of every row of `docs` (id and text).

    `evidence` lists the nearest examples with label and cosine. A score depends on the text
    alone, so equal texts score the same, and an example's own text finds itself. Null,
    empty and unknown texts have none and get the score of a vote that holds the sample's
    share alone. Rows without an id are scored as well.
    """
    return score_vectors(vectors_of(docs, vocabulary), index, k)


def score_vectors(vectors: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """`score` of the texts that `vectors_of` counted."""
    model = vectors.sparkSession.sparkContext.broadcast(index)  # bounded by the sample
    shape = ("id bigint, score double, predicted int, "
             "evidence array<struct<id:bigint,label:double,similarity:double>>")
    cell = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            scores, evidence = [], []
            ends = batch.column(1).offsets.to_numpy()
            held, times = (batch.column(i).values.to_numpy() for i in (1, 2))
            for at, to in zip(ends[:-1], ends[1:]):
                terms = held[at:to]
                found, cosine = index.nearest(terms, index.unit(terms, times[at:to].astype(float)), k)
                scores.append(index.score(index.vote(found, cosine)))
                evidence.append([
                    {"id": int(index.ids[i]), "label": float(index.labels[i]), "similarity": float(c)}
                    for i, c in zip(found[:3], cosine)
                ])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, cell),
            ], ["id", "score", "predicted", "evidence"])

    return vectors.select("id", "terms", "counts").mapInArrow(run, shape)
