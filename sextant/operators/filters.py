"""Compiler from the store's filter dictionaries to columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def where(spec: dict | None) -> Column:
    """Keys are joined by AND; $and/$or nest; a field's range operators make its $contains void; unknown ones drop out."""
    parts = []
    for key, v in (spec or {}).items():
        if key in ("$and", "$or"):
            subs = [where(s) for s in v]
            if subs:  # an empty list restricts nothing
                parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), subs))
        elif not isinstance(v, dict):
            parts.append(F.col(key) == v)
        else:
            ranges = [getattr(F.col(key), _RANGE[o])(x) for o, x in v.items() if o in _RANGE]
            if ranges:
                parts += ranges
            elif "$contains" in v:
                parts.append(F.col(key).contains(v["$contains"]))
            for o, f in (("$eq", lambda x: F.col(key) == x), ("$ne", lambda x: F.col(key) != x), ("$in", lambda x: F.col(key).isin(x)), ("$nin", lambda x: ~F.col(key).isin(x))):
                if o in v:
                    parts.append(f(v[o]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def where_document(spec: dict | None, col: str = "text") -> Column:
    return F.col(col).contains(spec["$contains"]) if spec and "$contains" in spec else F.lit(True)


def delete_condition(spec: dict | None = None, document: dict | None = None, col: str = "text") -> Column:
    """The condition of a delete: on the fields or on the text, but not on both and not on neither."""
    if bool(spec) == bool(document):
        raise ValueError("give a condition on the fields or on the document, one of them")
    return where(spec) if spec else where_document(document, col)


def query_condition(spec: dict | None = None, document: dict | None = None, col: str = "text") -> Column:
    """The condition of a query: fields and text must both agree, as far as they are given."""
    return where(spec) & where_document(document, col)
