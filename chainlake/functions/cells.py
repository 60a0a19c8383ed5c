"""Typed cells: canonical bytes, salts and hashes, as Spark expressions.

A cell's hash is SHA-256 of its salt (if any), its type byte and its canonical bytes. Everything here stays in generated
JVM code but decimals of more than 18 digits, which take an Arrow UDF.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type byte that is hashed with a cell's bytes.
NULL, STRING, LONG, BIG_INT, BIG_DEC, DATE, BOOL, BYTES, HASH = range(9)
TYPE_NAMES = ("NULL", "STRING", "LONG", "BIG_INT", "BIG_DEC", "DATE", "BOOL", "BYTES", "HASH")
#: The bytes of a null cell.
NULL_BYTES = bytes(5)
SENTINEL = bytes(32)
NUMERIC_TYPES = (LONG, BIG_INT, BIG_DEC, DATE)


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def long_bytes(value: Column) -> Column:
    """8 bytes, big-endian two's complement."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def utc_millis(value: Column, kind: T.DataType) -> Column:
    """Milliseconds since 1970 UTC. Times without a zone count as UTC, whatever the session's zone is."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long") * 86_400_000
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)
    return F.unix_millis(value)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def minimal_hex(value: Column) -> Column:
    """Hex of the shortest two's complement bytes of a long."""

    def shortest(v: Column) -> Column:
        # a first digit of 8 or more would say that the number is negative
        positive = let(F.hex(v), lambda raw: F.when(F.length(raw) % 2 == 1, F.concat(F.lit("0"), raw)).when(raw >= "8", F.concat(F.lit("00"), raw)).otherwise(raw))
        # every FF in front of a byte that is negative by itself says nothing
        negative = F.regexp_replace(F.hex(v), "^(?:FF)+(?=[89A-F][0-9A-F])", "")
        return F.when(v < 0, negative).otherwise(positive)

    return let(value, shortest)


def decimal_bytes(value: Column, kind: T.DecimalType) -> Column:
    """One signed scale byte, then the unscaled value's shortest bytes, zeros at the end of the number stripped."""
    if kind.precision > 18:
        return _wide_decimal(value.cast("string"))

    def from_digits(digits: Column) -> Column:
        # digits: the unscaled value as text; what is left of it without its last zeros gives the scale
        return let(F.rtrim(digits, F.lit("0")), lambda left: F.unhex(F.concat(_scale_hex(digits, left), minimal_hex(F.when(F.length(left) == 0, F.lit("0")).otherwise(left).cast("long")))))

    def _scale_hex(digits: Column, left: Column) -> Column:
        scale = F.when(F.length(left) == 0, F.lit(0)).otherwise(F.lit(kind.scale) - F.length(digits) + F.length(left))
        return F.lpad(F.hex(F.pmod(scale, F.lit(256))), 2, "0")

    unscaled = (value * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("long").cast("string")
    return let(unscaled, from_digits)


def big_decimal(text: str) -> bytes:
    """The canonical bytes of a decimal number of any size, given as text."""
    from decimal import Decimal

    sign, digits, exponent = Decimal(text).as_tuple()
    number = int("".join(map(str, digits)))
    if number == 0:
        return b"\0\0"
    while number % 10 == 0:
        number //= 10
        exponent += 1
    if not -128 <= -exponent <= 127:
        raise ValueError(f"the scale {-exponent} doesn't fit a byte")
    return (-exponent).to_bytes(1, "big", signed=True) + big_integer(-number if sign else number)


def big_integer(number: int) -> bytes:
    """The shortest two's complement bytes, at least one."""
    return number.to_bytes((number if number >= 0 else ~number).bit_length() // 8 + 1, "big", signed=True)


def _wide_decimal(text: Column) -> Column:
    import pandas as pd

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else big_decimal(v))

    return encoded(text)


def typed(value: Column, kind: T.DataType, name: str = "") -> tuple[Column, Column]:
    """(type byte, canonical bytes) of a column; null cells get NULL and its bytes. Floats and nested types are refused."""
    if isinstance(kind, T.StringType):
        code, data = F.lit(STRING), F.encode(value, "UTF-8")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        code, data = F.lit(LONG), long_bytes(value)
    elif isinstance(kind, T.DecimalType):
        code, data = F.lit(BIG_DEC), decimal_bytes(value, kind)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        code, data = F.lit(DATE), long_bytes(utc_millis(value, kind))
    elif isinstance(kind, T.BooleanType):
        code, data = F.lit(BOOL), F.when(value, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    elif isinstance(kind, T.BinaryType):
        code, data = F.when(F.octet_length(value) == 32, F.lit(HASH)).otherwise(F.lit(BYTES)), value
    elif isinstance(kind, T.NullType):
        return F.lit(NULL), F.lit(NULL_BYTES)
    else:
        raise TypeError(f"column {name!r} of type {kind.simpleString()} can't be a cell; cast it to a decimal, string or binary first")
    return F.when(value.isNull(), F.lit(NULL)).otherwise(code), F.when(value.isNull(), F.lit(NULL_BYTES)).otherwise(data)


def type_byte(code: Column) -> Column:
    return F.unhex(F.lpad(F.hex(code.cast("long")), 2, "0"))


def hashed_bytes(value: Column, kind: T.DataType, name: str = "") -> Column:
    """Type byte and canonical bytes in one expression with one test for null: the plan stays half as large as by typed()."""
    if isinstance(kind, T.NullType):
        return F.lit(bytes([NULL]) + NULL_BYTES)
    solid = {T.StringType: STRING, T.DecimalType: BIG_DEC, T.BooleanType: BOOL, T.DateType: DATE, T.TimestampType: DATE, T.TimestampNTZType: DATE}
    code = LONG if isinstance(kind, T.IntegralType) else next((c for t, c in solid.items() if isinstance(kind, t)), None)
    data = _plain_bytes(value, kind, name)
    first = F.lit(bytes([code])) if code is not None else F.when(F.octet_length(value) == 32, F.lit(bytes([HASH]))).otherwise(F.lit(bytes([BYTES])))
    return F.coalesce(F.concat(first, data), F.lit(bytes([NULL]) + NULL_BYTES))


def _plain_bytes(value: Column, kind: T.DataType, name: str) -> Column:
    """The canonical bytes, null for null."""
    if isinstance(kind, T.StringType):
        return F.encode(value, "UTF-8")
    if isinstance(kind, T.IntegralType):
        return long_bytes(value)
    if isinstance(kind, T.DecimalType):
        return decimal_bytes(value, kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return long_bytes(utc_millis(value, kind))
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit(b"\x01")).when(~value, F.lit(b"\x00"))
    if isinstance(kind, T.BinaryType):
        return value
    raise TypeError(f"column {name!r} of type {kind.simpleString()} can't be a cell; cast it to a decimal, string or binary first")


def row_salt(seed: Column, row_no: Column) -> Column:
    """SHA-256 of the row number, the seed and the row number's complement."""
    return sha256(F.concat(long_bytes(row_no), seed, long_bytes(F.bitwise_not(row_no.cast("long")))))


def cell_salt(row: Column, index: int) -> Column:
    return sha256(F.concat(F.lit(index.to_bytes(8, "big")), row, F.lit((~index).to_bytes(8, "big", signed=True))))


def cell_hash(code: Column, data: Column, salt: Column | None = None) -> Column:
    plain = F.concat(type_byte(code), data)
    return sha256(plain if salt is None else F.concat(salt, plain))


def row_hash(hashes: list[Column]) -> Column:
    """No cells: the sentinel. One: its own hash. More: the hash of all, in order."""
    if not hashes:
        return F.lit(SENTINEL)
    return hashes[0] if len(hashes) == 1 else sha256(F.concat(*hashes))


def row_hash_of_array(hashes: Column) -> Column:
    """row_hash() of an array of hashes in order."""
    whole = F.unhex(F.array_join(F.transform(hashes, lambda h: F.hex(h)), ""))
    return F.when(F.size(hashes) == 0, F.lit(SENTINEL)).when(F.size(hashes) == 1, hashes[0]).otherwise(sha256(whole))


class SaltScheme:
    """Which cell indices are salted: all, none, some, or all but some."""

    def __init__(self, indices: tuple[int, ...] = (), positive: bool = True):
        self.indices, self.positive = tuple(sorted(set(indices))), positive
        if any(i < 0 for i in self.indices):
            raise ValueError("cell indices start at 0")

    def salted(self, index: int) -> bool:
        return (index in self.indices) == self.positive


SALT_ALL, NO_SALT = SaltScheme((), False), SaltScheme((), True)


def cells_of(df: DataFrame, columns: list[str], scheme: SaltScheme = NO_SALT, salt: str | None = None) -> list[Column]:
    """One struct (type, data, salt, hash) for each column. salt: the column that holds the row's salt."""
    out = []
    for i, name in enumerate(columns):
        code, data = typed(F.col(name), df.schema[name].dataType, name)
        own = cell_salt(F.col(salt), i) if salt and scheme.salted(i) else None
        plain = hashed_bytes(F.col(name), df.schema[name].dataType, name)
        hash_ = sha256(plain if own is None else F.concat(own, plain))
        out.append(F.struct(code.cast("tinyint").alias("type"), data.alias("data"), (own if own is not None else F.lit(None).cast("binary")).alias("salt"), hash_.alias("hash")))
    return out
