"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from attrition.session import ensure_checkpoint_dir

#: Texts are handed to the per-batch helpers in blocks of at most this many
#: characters (a single longer text is a block of its own), so that the memory
#: of a task doesn't depend on how many rows Arrow puts into a batch.
BLOCK_CHARS = 4_000_000

KEY_1, KEY_2 = "__doc_key_1", "__doc_key_2"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder, read back.

    Columnar, so later scans read only the columns they need; survives the loss
    of any executor.
    """

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrition-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of an Arrow batch with their texts (null: empty) as Python strings."""

    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > BLOCK_CHARS:
            yield batch.slice(start, i - start), [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), [t or "" for t in texts.slice(start).to_pylist()]


def map_rows(docs: DataFrame, run: Callable, added: list[StructField] = ()) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names; ``run`` may append ``added`` columns.

    ``run`` sees every column but ``text`` under a plain positional name.
    """

    fields = docs.schema.fields
    plain = [f.name if f.name == "text" else f"_c{i}" for i, f in enumerate(fields)]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, fields)] + list(added))
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, *(f.name for f in added))


def with_key(docs: DataFrame) -> DataFrame:
    """Add a 128-bit row key of (doc_id, text).

    Rows that agree in both count as one document wherever a key is needed, so a
    null or repeated ``doc_id`` neither breaks a join nor gathers rows on one key.
    """

    return docs.withColumns({
        KEY_1: F.xxhash64(F.lit(1), "doc_id", "text"),
        KEY_2: F.xxhash64(F.lit(2), "text", "doc_id"),
    })
