"""Numbered errors. The numbers are stable: callers may switch on ``EngineError.code``."""

from __future__ import annotations

MESSAGES = {
    0: "internal error", 2: "the connection is closed", 101: "no table {0}", 105: "statistics of a transaction that has not ended",
    106: "{0} is outside the transaction's scope", 107: "a transaction cannot go from {0} to {1}", 108: "the stored data has a newer version",
    110: "import needs an empty database", 111: "the import is for another database or version", 112: "the import holds no data",
    113: "already connected", 201: "{0}: key exists already", 202: "null in column {0}", 203: "foreign key {0} is violated", 300: "not supported",
    500: "not allowed here: {0}", 501: "a parameter has no value", 502: "bad name {0}", 503: "name {0} is taken", 504: "only an integer key counts up",
    505: "only a key of one column counts up", 506: "a cascading foreign key is checked at once", 508: "table {0} has no column {1}",
    509: "column {1} of table {0} cannot be indexed", 510: "too few values to bind", 515: "from was given", 516: "where was given", 517: "delete needs from",
    518: "insert needs into and values", 519: "upsert needs a primary key", 520: "into was given", 521: "values were given", 522: "select needs from",
    523: "limit or skip has no value", 524: "distinct stands alone", 525: "a column cannot be grouped by", 526: "aggregates and columns without grouping",
    527: "aggregate {0} does not fit its column", 528: "limit was given", 529: "skip was given", 530: "grouping was given", 531: "limit and skip are not negative",
    532: "update needs set", 533: "foreign keys form a loop", 534: "a foreign key refers to a column that is one itself", 535: "the schema is final",
    536: "foreign key {0}: no such table", 537: "foreign key {0}: no such column", 538: "foreign key {0}: types differ", 539: "foreign key {0}: the parent is not unique",
    540: "foreign key {0}: bad reference", 541: "an outer join takes one join predicate", 542: "join needs from first", 543: "a primary key cannot be a foreign key",
    544: "{0} repeats the primary key", 545: "a primary key cannot be nullable", 546: "name {0} repeats the table's", 547: "join comes before where",
    548: "where needs from first", 549: "ordering and grouping need from first", 550: "predicate {1} does not fit type {0}",
}


class EngineError(Exception):
    def __init__(self, code: int, *args):
        self.code = code
        super().__init__(f"{code}: {MESSAGES.get(code, 'error').format(*(list(args) + ['?', '?']))}")
