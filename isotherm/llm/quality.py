"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every document becomes a row of statistics (length, variety, character classes, repetition). Random cosines of the
standardised statistics approximate a Gaussian kernel; the ridge weights solve normal equations that tasks sum over their
rows; a monotone curve fitted on rows kept aside turns the raw score into a probability.

The labels that are learnt from are a documented, bounded sample (``MAX_LABELLED``); statistics cover every row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import fold, map_batches, texts
from isotherm.session import materialize

#: about so many labelled rows are learnt from at most, chosen by a hash of the id
MAX_LABELLED = 200_000
FEATURES, BANDWIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 7
#: steps of the raw score that the calibration counts in; bounds what the driver sees
STEPS = 500
STATISTICS = (
    "words", "unique", "mean_length", "spread_length", "letters", "upper", "digits", "marks", "bangs", "bars", "symbols", "space",
    "lines", "adjacent", "top_word", "repeated_lines", "repeated_pairs", "squeeze", "stops", "short_lines",
)
_LETTER, _UPPER, _DIGIT = (np.array([ok(b) for b in range(256)]) for ok in (lambda b: b >= 128 or chr(b).isalpha(), lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57))
_BANG, _BAR, _SPACE = (np.isin(np.arange(256), list(chars)) for chars in (b"!?", b"|", b" \t\n\r\x0b\x0c"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*@^~<>{}[]=_\\/+"))
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _BANG, _BAR, _SYMBOL, _SPACE]).astype(np.float64)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all 0 for an empty one."""
    data, words = text.encode(), text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    letters, upper, digits, bangs, bars, symbols, space = _CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    count, lengths, lines = len(words), np.fromiter(map(len, words), np.float64, len(words)), text.split("\n")
    seen = Counter(words)
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(count), len(seen) / count, np.log(lengths.mean()), np.log1p(lengths.std()), letters, upper, digits, 1 - letters - digits - space, bangs, bars, symbols, space,
        np.log1p(len(lines)) - np.log1p(count), sum(a == b for a, b in zip(words, words[1:])) / count, max(seen.values()) / count, 1 - len(set(lines)) / len(lines),
        1 - len(pairs) / max(1, count - 1), len(zlib.compress(data, 1)) / len(data), sum(w.endswith((".", "!", "?")) for w in words) / count, sum(len(x) < 40 for x in lines) / len(lines),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` with the statistics of every row, written once."""

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id").to_pylist(), "x": [statistics(t) for t in batch.column("text").to_pylist()]}

    return materialize(map_batches(texts(docs), "doc_id long, x array<double>", make), "statistics")


class Model(NamedTuple):
    """Everything a score needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines(self, x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels) if len(self.knots) else np.full(len(x), self.levels[0])


def _projection() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.normal(0, 1 / BANDWIDTH, (len(STATISTICS), FEATURES)), random.uniform(0, 2 * np.pi, FEATURES)


def cosines(model: Model, x: np.ndarray) -> np.ndarray:
    """Random features of rows of statistics, with a leading one."""
    turn, phase = _projection()
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ turn + phase)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


def pooled(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of ``(place, rows, positives)`` by pooling adjacent violators: knots and their levels."""
    blocks: list[list[float]] = []
    for at, rows, hits in sorted(points):
        blocks.append([rows, hits, at * rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([s / n for n, _, s in blocks]), np.array([h / n for n, h, _ in blocks])


def fit(known: DataFrame) -> Model:
    """Fits ``doc_id, x, y``: four fifths of the rows for the weights, the rest for the curve.

    Without rows the score is 1 (nothing can be rejected); with one class only it is that class.
    """
    width = len(STATISTICS)
    each = [F.col("x")[k] for k in range(width)]
    moments = known.agg(F.count("y").alias("n"), F.avg("y").alias("rate"), *[f(c).alias(f"{f.__name__}{k}") for k, c in enumerate(each) for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"] or moments["rate"] in (0.0, 1.0):
        return Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), np.zeros(0), np.array([moments["rate"] if moments["n"] else 1.0]))
    scale = np.array([moments[f"stddev_pop{k}"] for k in range(width)])
    start = Model(np.array([moments[f"avg{k}"] for k in range(width)]), np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(0), np.ones(1))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = cosines(start, _matrix(batch))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False).astype(float)])
        at = np.arange(FEATURES + 1)
        i, j = np.meshgrid(at, np.arange(FEATURES + 2), indexing="ij")
        keep = j >= i
        yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(total[keep])], ["i", "j", "v"])

    parts = known.where(~aside).select("x", "y").mapInArrow(sums, "i int, j int, v double")
    table = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # (features + 1)^2 / 2 numbers, whatever the corpus
    equations = np.zeros((FEATURES + 1, FEATURES + 2))
    equations[table["i"].to_numpy(), table["j"].to_numpy()] = table["v"].to_numpy()
    gram, target = equations[:, :-1], equations[:, -1]
    gram = np.triu(gram) + np.triu(gram, 1).T
    penalty = np.full(FEATURES + 1, RIDGE * gram[0, 0])
    penalty[0] = 0
    model = start._replace(weights=np.linalg.solve(gram + np.diag(penalty + 1e-9), target))

    def raw():
        return lambda batch: {"at": np.round(model.raw(_matrix(batch)) * STEPS).clip(-STEPS, 2 * STEPS), "y": batch.column("y")}

    kept = map_batches(known.where(aside).select("x", "y"), "at double, y int", raw)
    points = [(r["at"] / STEPS, r["n"], r["hits"]) for r in kept.groupBy("at").agg(F.count("y").alias("n"), F.sum("y").alias("hits")).collect()]
    if not points:
        points = [(0.0, 1, 0), (1.0, 1, 1)]
    knots, levels = pooled(points)
    return model._replace(knots=knots, levels=levels)


def labelled(labels: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    """``doc_id, y`` of training rows: at most about ``MAX_LABELLED``, chosen by a hash of the id.

    Rows without id or label are left out; of several labels of one id the smallest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna()
    known = known.where(fold(F.col("doc_id"), modulus) != held)
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.min("y").alias("y"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; labels of ``crc32(doc_id) mod 4 = 2`` are not used.

    Empty and null texts have statistics of 0 and a score like any other; repeated rows are scored each.
    """
    rows = described(docs)
    # the bounded sample is broadcast, so statistics are never shuffled
    known = rows.join(F.broadcast(labelled(labels, "quality", 4, 2)), "doc_id").dropDuplicates(["doc_id"])
    model = fit(materialize(known, "quality-known"))

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": model.score(_matrix(batch))}

    scored = map_batches(rows, "doc_id long, score double", make)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``, all columns kept. The score is a function of the text
    alone, so texts are scored where they lie and never dealt out."""
    rows = described(docs)
    known = rows.join(F.broadcast(labelled(labels, "quality", 4, 2)), "doc_id").dropDuplicates(["doc_id"])
    model = fit(materialize(known, "quality-known"))

    @F.pandas_udf("double")
    def scored(text):
        return pd.Series(model.score(np.array([statistics(t or "") for t in text])))

    return docs.where(scored(F.col("text")) >= threshold)
