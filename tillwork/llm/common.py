"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo ``modulus``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A to Z lower-cased and nothing else (bytes.lower is ASCII only)."""
    return text.encode().lower().split() if text else []


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: list[tuple[str, T.DataType]],
    work: Callable[[Iterator[list[list]]], Iterator[list[list]]],
    keep: list[str] | None = None,
    as_lists: bool = True,
    rows_at_once: int = 256,
) -> DataFrame:
    """Adds columns worked out in Python from Arrow batches.

    ``work`` gets an iterator of the input columns, ``rows_at_once`` rows at a time so that few texts
    are Python objects at once, as lists (or Arrow arrays), and yields the output columns. ``keep`` names the columns that are returned before them (all if None).
    """
    keep = list(df.columns) if keep is None else keep
    needed = df.select(*dict.fromkeys([*keep, *inputs]))
    fields = [needed.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in outputs]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(kind) for _, kind in outputs]
        seen: list[pa.RecordBatch] = []

        def columns() -> Iterator[list[list]]:
            for batch in (b.slice(i, rows_at_once) for b in batches for i in range(0, max(1, b.num_rows), rows_at_once)):
                seen.append(batch)
                found = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
                yield [c.to_pylist() for c in found] if as_lists else found

        for made in work(columns()):
            batch = seen.pop()
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            new = [v if isinstance(v, pa.Array) else pa.array(v, type=arrow[i]) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.names)

    return needed.mapInArrow(run, schema)
