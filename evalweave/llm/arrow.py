"""Running numpy code over the texts of a DataFrame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from evalweave.llm.shingles import chunks


def map_texts(df: DataFrame, text: str, schema: str, make: Callable[[pa.RecordBatch, list[str]], dict]) -> DataFrame:
    """Apply ``make(batch, texts)`` to pieces of ``df``; it returns the columns of ``schema`` by name.

    A piece holds about ``CHUNK_CHARS`` characters (one longer text is a piece of its own), so worker memory is bounded
    by the longest text and not by the batch.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(text).to_pylist()):
                out = make(batch.slice(first, len(texts)), texts)
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, kind)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
