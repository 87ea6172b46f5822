"""Packing by optimal length buckets.

A dynamic programme over the global histogram of lengths picks the bucket boundaries that leave the least padding; every
document goes to the narrowest bucket that holds it, and batches of a token budget form inside each bucket.

The histogram is exact: one row for each distinct length. Distinct lengths are few (k of them take at least k (k + 1) / 2
tokens), and the programme takes steps in proportion to their number. Positions inside a bucket come from small shards (a hash of
the row) and the shards' offsets, so a bucket that holds a third of all documents is numbered by many tasks.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.common import texts, word_count
from isotherm.session import materialize

#: rows a shard of a bucket holds on average
SHARD_ROWS = 20_000


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding over ``(length, count)``.

    ``cost(i, j]`` is linear in the boundary length for fixed ``i``, so each layer of the programme is a lower envelope
    of lines queried at rising places: ``len(histogram) * buckets`` steps. Of equal costs, fewer buckets win.
    """
    rows = sorted(histogram)
    lengths = [n for n, _ in rows]
    count, total = [0], [0]
    for n, c in rows:
        count.append(count[-1] + c)
        total.append(total[-1] + n * c)
    size = len(rows)
    if not size:
        return []
    # least[j]: padded tokens of the first j lengths with the buckets so far
    least = [0] + [None] * size
    layers: list[list[int]] = []
    for _ in range(min(buckets, size)):
        lines: deque[tuple[int, int, int]] = deque()  # slope, intercept, i: value = intercept + slope * boundary
        now: list[int | None] = [0] + [None] * size
        back = [0] * (size + 1)
        for j in range(1, size + 1):
            i = j - 1
            if least[i] is not None:
                slope, intercept = -count[i], least[i]
                while len(lines) >= 2:
                    (m1, c1, _), (m2, c2, _) = lines[-2], lines[-1]
                    if (intercept - c1) * (m1 - m2) <= (c2 - c1) * (m1 - slope):
                        lines.pop()
                    else:
                        break
                lines.append((slope, intercept, i))
            at = lengths[j - 1]
            while len(lines) >= 2 and lines[1][1] + lines[1][0] * at <= lines[0][1] + lines[0][0] * at:
                lines.popleft()
            if lines:
                slope, intercept, i = lines[0]
                now[j], back[j] = intercept + (count[j] + slope) * at, i
        layers.append(back)
        if least[size] is not None and now[size] >= least[size]:
            layers.pop()
            break
        least = now
    out, j = [], size
    for back in reversed(layers):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = back[j]
    return out[::-1]


def padding(histogram: list[tuple[int, int]], bounds: list[int]) -> int:
    """Padded tokens of a histogram under given upper bounds."""
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram)


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, length: Column | None = None) -> DataFrame:
    """``doc_id, n_tokens, bucket, pad_to, batch, slot`` of every row.

    ``length`` is the number of tokens of a row (by default its words and one end token; at least 1 is taken). A batch
    holds ``max(1, budget // pad_to)`` documents of one bucket; ``batch`` counts from 0 inside a bucket, ``slot`` inside
    a batch. Rows are dealt to shards of a bucket by a hash of their id and row, so that no id fills one, and ordered by id inside a shard; repeated rows
    take places of their own, null ids come first. An empty table gives no rows.
    """
    if buckets < 1 or budget < 1:
        raise ValueError("buckets and budget are at least 1")
    spark = docs.sparkSession
    if length is None:
        sized = texts(docs).select("doc_id", (word_count(F.col("text")) + 1).cast("long").alias("n_tokens"))
    else:
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.lit(1), F.coalesce(length, F.lit(1))).cast("long").alias("n_tokens"))
    sized = materialize(sized.select("*", F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = [(r["n_tokens"], r["n"]) for r in sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = boundaries(histogram, buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, pad_to long, batch long, slot int")
    shards = max(1, -(-sum(n for _, n in histogram) // SHARD_ROWS))
    steps = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = (
        sized.withColumn("bucket", F.size(F.filter(steps, lambda b: b < F.col("n_tokens"))))
        .withColumn("pad_to", F.element_at(steps, F.col("bucket") + 1))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
    )
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "row")
    at = F.col("offset") + F.col("place") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("pad_to"))).cast("long")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(offsets, ["bucket", "shard"])
        .select("doc_id", "n_tokens", "bucket", "pad_to", F.floor(at / capacity).cast("long").alias("batch"), (at % capacity).cast("int").alias("slot"))
    )
