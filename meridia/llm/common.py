"""What the training-data operators share: words, batches and written tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
#: On UTF-8 this equals the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text.
_ITEM_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in _LOWER)


def item_words(text: bytes | None) -> list[bytes]:
    """Words of digits, lower-cased letters and anything beyond ASCII; null has none."""
    return text.translate(_ITEM_WORDS).split() if text else []


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def blank_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+: what bytes.split() yields; null has none."""
    return text.split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that Python objects of a few rows live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, as in tests, a local session gets a temporary folder; a
    cluster without the setting is refused, since its machines share nothing else.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_dir(spark.sparkContext.master)
    return found.rstrip("/")


@functools.cache
def _own_dir(master: str) -> str:
    if not re.match(r"local($|\[)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="meridia-")


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again.

    A lost executor then costs no more than the tasks it was running. Column
    `parts`, if given, become folders.
    """
    path = f"{scratch_dir(df.sparkSession)}/meridia/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all written tables of this library; call it when no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/meridia")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores before it as long as a column has it already."""
    known = {c.lower() for c in columns}
    while name in known:
        name = "_" + name
    return name
