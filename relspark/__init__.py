"""A relational analytics engine on Spark DataFrames: typed schemas, fluent queries, constraints, transactions, live queries."""

from .database import Database, Transaction, TransactionStats
from .errors import EngineError
from .functions import bind, fn, op
from .predicates import Binder
from .schema import IndexedColumn, SchemaBuilder, create
from .types import ConstraintAction, ConstraintTiming, DataStoreType, Order, TransactionType, Type

__all__ = [
    "Binder", "ConstraintAction", "ConstraintTiming", "DataStoreType", "Database", "EngineError", "IndexedColumn", "Order",
    "SchemaBuilder", "Transaction", "TransactionStats", "TransactionType", "Type", "bind", "create", "fn", "op",
]
