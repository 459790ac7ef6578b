"""Column types, what each allows, and the enumerations of the interface."""

from __future__ import annotations

from enum import Enum, IntEnum

from pyspark.sql import types as T


class Type(Enum):
    STRING = "string"
    NUMBER = "double"
    INTEGER = "bigint"
    BOOLEAN = "boolean"
    DATE_TIME = "timestamp"
    OBJECT = "json"
    ARRAY_BUFFER = "binary"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def default(self):
        return _DEFAULT.get(self)

    @property
    def keyable(self) -> bool:
        return self not in (Type.OBJECT, Type.ARRAY_BUFFER)


class Order(IntEnum):
    DESC = 0
    ASC = 1


class ConstraintAction(Enum):
    RESTRICT = "restrict"
    CASCADE = "cascade"


class ConstraintTiming(Enum):
    IMMEDIATE = "immediate"
    DEFERRABLE = "deferrable"


class DataStoreType(Enum):
    MEMORY = "memory"
    PARQUET = "parquet"
    JSON = "json"


class TransactionType(Enum):
    READ_ONLY = "r"
    READ_WRITE = "rw"


_SPARK = {Type.STRING: T.StringType(), Type.NUMBER: T.DoubleType(), Type.INTEGER: T.LongType(), Type.BOOLEAN: T.BooleanType(), Type.DATE_TIME: T.TimestampType(), Type.OBJECT: T.StringType(), Type.ARRAY_BUFFER: T.BinaryType()}
_DEFAULT = {Type.STRING: "", Type.NUMBER: 0.0, Type.INTEGER: 0, Type.BOOLEAN: False}
_ORDERED = frozenset(("eq", "neq", "lt", "lte", "gt", "gte", "between", "in"))
ALLOWED = {Type.STRING: _ORDERED | {"match"}, Type.NUMBER: _ORDERED, Type.INTEGER: _ORDERED, Type.DATE_TIME: _ORDERED, Type.BOOLEAN: frozenset(("eq", "neq")), Type.OBJECT: frozenset(("eq", "neq")), Type.ARRAY_BUFFER: frozenset()}


def type_of(kind: T.DataType) -> Type:
    """The column type of a Spark type, for schemas read from files."""
    if isinstance(kind, T.BooleanType):
        return Type.BOOLEAN
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Type.DATE_TIME
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Type.INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Type.NUMBER
    if isinstance(kind, T.BinaryType):
        return Type.ARRAY_BUFFER
    return Type.STRING if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else Type.OBJECT
