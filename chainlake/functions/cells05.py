"""The older cell format: hashes without a type byte, salts by seed, row and column, doubles allowed.

A value's own hash: SHA-256 of 8 bytes for whole numbers, times (UTC milliseconds) and doubles; of a 4-byte length and the bytes for
strings and binaries; the sentinel for nulls. A salted cell hashes its salt and that. A row hashes all its cells' hashes, also
if it has one cell only. Columns count from 1 in salts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions import cells as C


def _double_bytes(value: Column) -> Column:
    import pandas as pd

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        raw = values.to_numpy(dtype=">f8", na_value=0.0).tobytes()
        return pd.Series([raw[8 * i : 8 * i + 8] for i in range(len(values))])

    return encoded(value)


def value_hash(value: Column, kind: T.DataType, name: str = "") -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data = F.encode(value, "UTF-8") if isinstance(kind, T.StringType) else value
        whole = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 8, "0")), data)
    elif isinstance(kind, T.IntegralType):
        whole = C.long_bytes(value)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        whole = C.long_bytes(C.utc_millis(value, kind))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = _double_bytes(value.cast("double"))
    else:
        raise TypeError(f"column {name!r} of type {kind.simpleString()} has no older form")
    return F.when(value.isNull(), F.lit(C.SENTINEL)).otherwise(C.sha256(whole))


def salt(seed: bytes, row: Column, column: int) -> Column:
    if len(seed) != 32:
        raise ValueError("older seeds have 32 bytes")
    return C.sha256(F.concat(F.lit(seed), C.long_bytes(row), F.lit(column.to_bytes(8, "big"))))


def with_input_hash(df: DataFrame, columns: list[str], *, seed: bytes | None = None, row: str = "row_no", name: str = "input_hash") -> DataFrame:
    """df with the older hash of its row of cells, salted if there's a seed."""
    hashes = [value_hash(F.col(c), df.schema[c].dataType, c) for c in columns]
    if seed is not None:
        hashes = [C.sha256(F.concat(salt(seed, F.col(row), i), h)) for i, h in enumerate(hashes, 1)]
    return df.withColumn(name, C.sha256(F.concat(*hashes)))
