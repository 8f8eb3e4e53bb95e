"""The log's schema, its codes, the five kinds of error, and named key orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Sequences have 56 bits.
MAX_SEQUENCE = 2**56 - 1


class StoreError(Exception):
    """Base of what the store raises."""


class NotFound(StoreError):
    pass


class Corruption(StoreError):
    pass


class NotSupported(StoreError):
    pass


class InvalidArgument(StoreError):
    pass


class StoreIOError(StoreError):
    pass


def log_schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    """``(key, seq, op, value)``; keys and values are binary unless other types are named."""
    return T.StructType([T.StructField("key", key or T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("value", value or T.BinaryType(), True)])


#: A key order is a name and an expression whose ascending order it is; the name is stored with a table and checked on opening.
_ORDERS: dict[str, Callable[[Column], Column]] = {"bytewise": lambda key: key}


def register_order(name: str, expression: Callable[[Column], Column]) -> None:
    if name in _ORDERS and name == "bytewise":
        raise InvalidArgument("the order 'bytewise' can't be replaced")
    _ORDERS[name] = expression


def sort_key(name: str = "bytewise", column: str | Column = "key") -> Column:
    if name not in _ORDERS:
        raise InvalidArgument(f"unknown key order: {name}")
    return _ORDERS[name](F.col(column) if isinstance(column, str) else column)


# Orders by a decimal number in the key, and by the key's bytes downwards (each byte subtracted from 255).
register_order("numeric", lambda key: key.cast("string").cast("decimal(38,0)"))
