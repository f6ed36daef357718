"""What the operators of this subpackage share."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import shared_folder

#: A word, and the white space between words, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same lower-casing for UTF-8 bytes; ``bytes.split()`` cuts at exactly SPACE.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder of its own, as in
    tests; on a cluster it is an error, as executors don't see each other's disks.
    """
    local = spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.split("[")[0] == "local"
    return shared_folder(spark, tempfile.mkdtemp() if local else None).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, for loops.

    A table's size is known from its files. A checkpoint keeps the estimate of the
    plan before it, and such estimates multiply from join to join in a loop.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def crc_remainder(c: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batches, rows: int = 256):
    """Arrow batches cut so that no step holds many long texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def by_bytes(batches, column: str, most: int):
    """Arrow batches cut into runs of rows whose texts have ``most`` bytes together, or of one longer text."""
    for b in batches:
        at = 0
        sizes = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, upto - at)
            at = upto
