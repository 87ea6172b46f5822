"""Toxicity by multiple-instance learning.

Only documents are labelled, but what offends is a sentence. Each sentence gets a logistic score of its words; a document
is toxic unless every sentence is harmless (noisy-or), and the weights are learnt from document labels through that rule.
The sentences that carry a document's score are then its offending ones.

Words and word beginnings of four to eight letters are features if they lean to toxic training documents (counted over
all of them). Every feature that leans has a weight: up to 262,144 features one of its own, beyond that several share one
by their hash. Every step of the gradient is a sum over tasks; the driver sees one number for each weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import fold, map_batches, texts
from isotherm.session import materialize

#: about so many labelled rows are learnt from at most, chosen by a hash of the id
MAX_LABELLED = 200_000
STEPS, RATE, SHRINK = 60, 0.5, 1e-4
#: most weights; no feature is dropped beyond them
MAX_WEIGHTS = 1 << 18
#: a sentence offends if its own score reaches this
OFFENDS = 0.5
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
TOKEN = re.compile(r"\w+")
BEGINNINGS = range(4, 9)
#: words whose features a task remembers
MEMORY = 300_000
#: training tasks; the compact training rows are bounded by ``MAX_LABELLED``
TASKS = 12


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` of training rows (``crc32 mod 3`` is not 1); of several labels of one id the largest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna()
    known = known.where(fold(F.col("doc_id"), 3) != 1)
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("y").alias("y"))


def parts(word: str) -> list[str]:
    """The features a word may have: itself, and its beginnings marked with a caret."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def hashed(part: str) -> int:
    """64-bit hash of a feature, signed."""
    found = xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"))
    return found - (1 << 64) if found >> 63 else found


class Parts(dict):
    """``parts`` of a word, remembered: words come again from text to text."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= MEMORY:
            self.clear()
        found = parts(word)
        if len(word) <= 64:
            self[word] = found
        return found


def leaning_features(known: DataFrame) -> np.ndarray:
    """Hashes, ascending, of all words and beginnings of ``text, y`` rows that lean to toxic documents: in three or more
    of them, with a z-score of the log odds over 1.5."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_parts = Parts()
        for batch in batches:
            hits, all_rows = Counter(), Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = set().union(*map(known_parts.__getitem__, set(TOKEN.findall(text.lower()))))
                all_rows.update(words)
                if y:
                    hits.update(words)
            words = list(all_rows)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([hits[w] for w in words], pa.int64()), pa.array(list(all_rows.values()), pa.int64())], ["word", "hits", "n"])

    totals = known.agg(F.sum("y").alias("hits"), F.count("y").alias("n")).first()
    bad, all_rows = totals["hits"] or 0, totals["n"] or 0
    if not bad or bad == all_rows:
        return np.array([], np.int64)
    odds = F.log((F.col("hits") + 0.5) / (bad - F.col("hits") + 0.5)) - F.log((F.col("n") - F.col("hits") + 0.5) / (all_rows - bad - F.col("n") + F.col("hits") + 0.5))
    spread = F.sqrt(1 / (F.col("hits") + 0.5) + 1 / (F.col("n") - F.col("hits") + 0.5))
    counted = known.select("text", "y").mapInArrow(count, "word string, hits long, n long").groupBy("word").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    # 8 bytes a feature, from at most MAX_LABELLED rows
    leaning = counted.where((F.col("hits") >= 3) & (F.length("word") <= 64)).where(odds / spread > 1.5)
    hashes = leaning.select("word").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([hashed(w) for w in b.column(0).to_pylist()], pa.int64())], ["h"]) for b in batches), "h long")
    return np.unique(hashes.toArrow().column(0).to_numpy())


class Features(dict):
    """Features of a word, remembered: ``word -> ids``."""

    def __init__(self, hashes: np.ndarray, weights: int):
        # digests are unsigned
        self.slots = {h: k % weights for k, h in enumerate(hashes.view(np.uint64).tolist())}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        slots, digest = self.slots, xxhash.xxh64_intdigest
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) == len(word):  # a beginning of the letters is one of the bytes
            own = [raw, *(b"^" + raw[:k] for k in BEGINNINGS if len(raw) >= k)]
        else:
            own = [p.encode("utf-8", "surrogatepass") for p in parts(word)]
        found = tuple(slots[h] for h in map(digest, own) if h in slots)
        if len(word) <= 64:
            self[word] = found
        return found


def features_of(text: str, features: Features) -> tuple[list[tuple[int, int, list[int]]], int]:
    """``(start, end, features)`` of sentences that have any, and the number of the others."""
    found, plain, of_word = [], 0, features.__getitem__
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: keep the places right
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for m in SENTENCE.finditer(low):
        own = set().union(*map(of_word, TOKEN.findall(m[0])))
        if own:
            found.append((m.start(), m.end(), sorted(own)))
        else:
            plain += 1
    return found, plain


def softplus(z):
    return np.logaddexp(0, z)


def fit(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and weights (the last one is the bias) from ``text, y`` rows. Without toxic rows all scores are 0."""
    hashes = leaning_features(known)
    if not len(hashes):
        return hashes, np.array([-np.inf])
    size = min(len(hashes), MAX_WEIGHTS)
    shared = known.sparkSession.sparkContext.broadcast(hashes)

    def compact():
        features = Features(shared.value, size)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            rows = [features_of(t, features) for t in batch.column("text").to_pylist()]
            return {"y": batch.column("y").to_pylist(), "plain": [p for _, p in rows], "sentences": [[own for _, _, own in found] for found, _ in rows]}

        return step

    # equal rows weigh as often as they come, so they are stored once with their number
    shape = map_batches(known.select("text", "y"), "y int, plain int, sentences array<array<int>>", compact)
    distinct = shape.groupBy("y", "plain", "sentences").agg(F.count(F.lit(1)).alias("n")).coalesce(TASKS)
    rows = materialize(distinct.mapInArrow(packed, ", ".join(f"{c} binary" for c in PACKED)), "toxicity-known")
    weights = np.zeros(size + 1)
    weights[-1] = -5.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for turn in range(1, STEPS + 1):
        gradient = _gradient(rows, weights) + SHRINK * np.append(weights[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights - RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return hashes, weights


#: what ``packed`` holds of a batch, in the order of its columns, and how
PACKED = {"y": np.int8, "plain": np.int32, "n": np.int64, "sentences": np.int32, "size": np.int32, "ids": np.int32}


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of training rows as one row of plain numbers, which every step reads as they are: labels, plain sentences,
    copies and sentences of the rows, features of the sentences, and the features."""
    for batch in batches:
        if batch.num_rows:
            sentences = batch.column("sentences")
            lists = sentences.flatten()
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "plain", "n")}
            numbers |= {"sentences": np.diff(sentences.offsets.to_numpy()), "size": np.diff(lists.offsets.to_numpy()), "ids": lists.flatten().to_numpy(zero_copy_only=False)}
            yield pa.RecordBatch.from_arrays([pa.array([numbers[c].astype(t).tobytes()], pa.binary()) for c, t in PACKED.items()], list(PACKED))


def _gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Mean gradient of the noisy-or log loss over all ``packed`` rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(weights)), 0
        bias = weights[-1]
        for batch in batches:
            for row in batch.to_pylist():
                y, plain, n, sentences, size, ids = (np.frombuffer(row[c], t) for c, t in PACKED.items())
                count = len(y)
                owner = np.repeat(np.arange(count), sentences)
                inside = np.repeat(np.arange(len(size)), size)
                z = bias + np.bincount(inside, weights[ids], len(size))
                harm = np.bincount(owner, softplus(z), count) + plain * softplus(bias)
                slope = n * np.where(y > 0, -1 / np.expm1(np.maximum(harm, 1e-12)), 1.0)
                own = slope[owner] / (1 + np.exp(-z))
                total[:-1] += np.bincount(ids, own[inside], len(weights) - 1)
                total[-1] += own.sum() + (slope * plain).sum() / (1 + np.exp(-bias))
                seen += n.sum()
        at = np.append(np.flatnonzero(total), len(total))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(total, seen)[at])], ["k", "v"])

    sums = rows.mapInArrow(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(weights) + 1)
    out[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    return out[:-1] / max(1.0, out[-1])


def score_text(text: str, features: Features, weights: Sequence[float]) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and ``(start, end, score)`` of its offending sentences."""
    found, plain = features_of(text, features)
    bias = weights[-1]
    z = [bias + sum([weights[k] for k in own]) for _, _, own in found]
    harm = sum(map(_softplus, z)) + plain * _softplus(bias)
    # below zero a score is under a half; a little room for rounding
    own = [(s, e, 1 / (1 + math.exp(-min(v, 700)))) for (s, e, _), v in zip(found, z) if v > -1e-6]
    return -math.expm1(-harm), [x for x in own if x[2] >= OFFENDS]


def _softplus(z: float) -> float:
    """``softplus`` of one number, which numpy is slow for."""
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, sentences`` of every row; ``sentences`` lists start, end and score of offending ones.

    Labels of ``crc32(doc_id) mod 3 = 1`` are not used. Empty and null texts have no sentence and score 0; repeated rows
    are scored each; without toxic training rows everything scores 0.
    """
    plain = texts(docs)
    known = materialize(plain.join(F.broadcast(labelled(labels)), "doc_id").dropDuplicates(["doc_id"]), "toxicity-labelled")
    shared = docs.sparkSession.sparkContext.broadcast(fit(known))

    def make():
        hashes, weights = shared.value
        features, plain_weights = Features(hashes, len(weights) - 1), weights.tolist()

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            rows = [score_text(t, features, plain_weights) if len(hashes) else (0.0, []) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id").to_pylist(), "score": [s for s, _ in rows],
                "sentences": [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in rows],
            }

        return step

    scored = map_batches(plain, "doc_id long, score double, sentences array<struct<start: int, end: int, score: double>>", make)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
