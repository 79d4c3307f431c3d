"""Row-wise Python helpers run by Spark over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts handed to Python at a time, so that a batch of very long ones stays small.
CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of ``column`` pass ``CHUNK_BYTES``."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size > CHUNK_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, fn: Callable[[list[str]], dict[str, list]], added: StructType) -> DataFrame:
    """Keep the columns of ``df`` and add (or replace) what ``fn`` returns for its texts.

    Spark partitions the rows; ``fn`` sees a bounded list of texts, null as the
    empty text, and returns one list per added column.
    """
    names = [f.name for f in added.fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = StructType(kept + added.fields)
    target = to_arrow_schema(schema)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, column):
                texts = [t or "" for t in batch.column(column).to_pylist()]
                made = fn(texts)
                columns = [batch.column(n) for n in keep] + [pa.array(made[n], type=target.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=keep + names)

    return df.mapInArrow(run, schema)
