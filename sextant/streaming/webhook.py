"""Repository webhooks as rows: signatures over the raw body, dispatch by event, changed files of pushes."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The events that have a handler of their own; others count as pushes.
EVENTS = ["push", "pull_request", "release", "ping"]
PUSH = "ref string, commits array<struct<added array<string>, modified array<string>, removed array<string>>>"


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a string or binary column, by the built-in SHA-256."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def verified(body: Column, signature: Column, secret: str) -> Column:
    """Whether a header 'sha256=...' signs the raw body; false without one."""
    return F.coalesce(signature == F.concat(F.lit("sha256="), hmac_sha256(body, secret)), F.lit(False))


def event_kind(name: Column) -> Column:
    return F.when(name.isin(EVENTS), name).otherwise(F.lit("push"))


def branch(ref: Column) -> Column:
    return F.replace(ref, F.lit("refs/heads/"), F.lit(""))


def push(body: Column) -> Column:
    """The parts of a push's JSON body that are used: ref and the files of its commits."""
    return F.from_json(body, PUSH)


def changed_files(pushed: Column) -> Column:
    """Distinct files that any commit adds, modifies or removes, sorted."""
    none = F.array().cast("array<string>")
    per = F.transform(pushed["commits"], lambda c: F.concat(*(F.coalesce(c[x], none) for x in ("added", "modified", "removed"))))
    return F.array_sort(F.array_distinct(F.flatten(F.coalesce(per, F.array(none)))))


HANDLERS: dict = {}


def on(kind: str):
    """Register a handler of one kind of event: DataFrame -> DataFrame."""

    def add(f):
        HANDLERS[kind] = f
        return f

    return add


def dispatch(events: DataFrame, col: str = "kind") -> dict[str, DataFrame]:
    """Each registered handler's result for the events of its kind; other kinds are left out."""
    return {kind: handle(events.where(F.col(col) == kind)) for kind, handle in HANDLERS.items()}
