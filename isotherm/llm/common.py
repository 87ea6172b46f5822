"""Helpers the text operators share.

Conventions of every operator here: a null text counts as the empty text, a null id is carried through, repeated rows
stay separate rows unless the docstring says otherwise, and only the columns an operator names are read, so further
columns (of whatever name) never clash with its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.session import materialize

#: words of the text operators: runs of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of every row, with null texts as empty ones."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(id_column: Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus


def byte_words(text: str) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8: bytes know no letters and white space but those of ASCII."""
    return text.encode().lower().split()


#: column of ``numbered``
ROW = "_row_number"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a written table with ``ROW``, a number of each row, so that rows of one id or of none can be told apart."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def map_batches(frame: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """Maps Arrow batches to columns; ``make()`` runs once per task and returns the function of one batch."""
    fields = frame.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, fields)


def word_count(text: Column) -> Column:
    """Words per text, counted inside the JVM."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
