"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at three or fewer differing bits. Cut into two halves, one half of such a pair differs in
at most one bit. So each half is indexed as it stands and once for each of its 32 places with that bit left out
(a one-wildcard variant); two halves that differ in one bit meet in exactly one variant, equal halves meet in the plain
key. An equality join on (half, place, variant) finds every candidate, and the whole fingerprints are verified.

Equal fingerprints are one node, so copies by the thousand cost one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import ROW, byte_words, map_batches, numbered, texts
from isotherm.llm.graph import components
from isotherm.session import materialize, weighed

SEED = 42
HALVES, HALF_BITS = 2, 32


def fingerprint(text: str, size: int = 3) -> int:
    """Majority of the hash bits over all shingles of ``size`` words; 0 without words."""
    words = byte_words(text)
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size))))
    hashed = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 8192):
        ones += np.unpackbits(hashed[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id") -> DataFrame:
    """``doc_id`` (of ``id_column``), ``print`` (the 64 bits as a signed long) of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id").to_pylist(), "print": [x - (1 << 64) if x >> 63 else x for x in found]}

        return step

    return map_batches(texts(docs, id_column), "doc_id long, print long", make)


def _keys(prints: DataFrame) -> DataFrame:
    """The plain key (place 32) and the 32 one-wildcard variants of both halves: ``print, half, place, key``."""
    halves = F.array(F.shiftrightunsigned("print", HALF_BITS), F.col("print").bitwiseAND(F.lit((1 << HALF_BITS) - 1)))
    # the bit of the place is cleared; place 32 lies above a half and clears nothing
    masks = F.array(*[F.lit(~(1 << p)).cast("long") for p in range(HALF_BITS + 1)])
    whole = prints.select("print", F.posexplode(halves).alias("half", "bits"))
    return whole.select("print", "half", "bits", F.posexplode(masks).alias("place", "mask")).select("print", "half", "place", "bits", F.col("bits").bitwiseAND(F.col("mask")).alias("key"))


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def linked(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``a, b`` (a < b) of distinct fingerprints at ``bits`` (at most 3) or fewer differing bits, each pair once.

    A pair whose halves both are within one bit meets in both; it is kept from the first only.

    Spark sizes the keys by the fingerprints they come from and knows nothing of their 66 rows each, so it would broadcast
    one side of the join; the hint has both sides dealt out at any size.
    """
    if bits > 3:
        raise ValueError("two halves cover at most three differing bits")
    keys = _keys(prints)
    a, b = keys.alias("a"), keys.alias("b")
    apart = differing_bits(F.col("a.print"), F.col("b.print"))
    first_half = differing_bits(F.shiftrightunsigned("a.print", HALF_BITS), F.shiftrightunsigned("b.print", HALF_BITS))
    met = (
        (F.col("a.print") < F.col("b.print"))
        & ((F.col("a.bits") != F.col("b.bits")) | (F.col("a.place") == HALF_BITS))  # equal halves meet in the plain key alone
        & (apart <= bits)
        & ((F.col("a.half") == 0) | (first_half > 1))
    )
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.half") == F.col("b.half"))
    return a.hint("merge").join(b, same & met).select(F.col("a.print").alias("a"), F.col("b.print").alias("b"))


def _placed(prints: DataFrame, bits: int) -> DataFrame:
    """Adds ``root``, the component's smallest fingerprint, to distinct fingerprints ``print``."""
    roots = components(linked(prints.select("print"), bits))
    return prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, bits: int = 3, size: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest id reachable through links (rows without words share the fingerprint zero and link
    like any others); it is null only where no row of the component has an id. Repeated rows are returned each.
    """
    rows = materialize(fingerprints(docs, size), "fingerprints")
    placed = _placed(rows.groupBy("print").agg(F.min("doc_id").alias("low")), bits)
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = placed.join(ids, "root").select("print", "component_id")
    # rows of one fingerprint may be a third of all; the table beside them has one row for each fingerprint
    return weighed(rows).join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 3, size: int = 3) -> DataFrame:
    """``docs`` without later members of a component: of each, the row with the smallest id stays (without ids, the row
    read first). Of several rows of that id, the first of them stays; rows of one id in two components are two documents.
    All columns are kept.
    """
    rows = numbered(docs)
    found = fingerprints(rows, size, ROW).withColumnRenamed("doc_id", ROW)
    with_id = materialize(found.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW))
    placed = _placed(with_id.groupBy("print").agg(first.alias("low")), bits)
    stays = placed.groupBy("root").agg(F.min("low").alias("low")).select(F.col(f"low.{ROW}").alias(ROW))
    return rows.join(stays, ROW, "left_semi").select(*docs.columns)
