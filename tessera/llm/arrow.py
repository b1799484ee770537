"""Arrow plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; a batch of very long texts stays small this way.
BATCH_ROWS = 256

#: ASCII white space, [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def small_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; decoding isn't needed for ASCII rules."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def without(df: DataFrame, names: list[str]) -> list[str]:
    """df's columns but those that are called like one of names, in any case."""
    clash = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in clash]


def fresh(df: DataFrame, name: str) -> str:
    """name, longer if df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]],
    fields: list[tuple[str, T.DataType]],
    text_col: str = "text",
    keep: list[str] | None = None,
    extra: list[str] | None = None,
) -> DataFrame:
    """df's columns (or those in keep) and new ones that make()'s function derives
    from whole batches of texts and of the columns in extra, which it consumes.
    No shuffle; a new column replaces one of its name."""
    extra = extra or []
    kept = without(df, [*(n for n, _ in fields), *extra]) if keep is None else keep
    own = text_col in kept and isinstance(df.schema[text_col].dataType, T.StringType)  # then it's sent once
    at = kept.index(text_col) if own else len(kept)
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if own else [F.col(f"`{text_col}`").cast("string").alias(fresh(df, "__text"))]), *extra)
    after = len(kept) + (not own)
    out = T.StructType([*source.schema.fields[: len(kept)], *(T.StructField(n, t, True) for n, t in fields)])
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                more = [batch.column(after + k).to_pylist() for k in range(len(extra))]
                new = each(as_bytes(batch.column(at)), *more)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=names)

    return small_batches(source).mapInArrow(run, out)
