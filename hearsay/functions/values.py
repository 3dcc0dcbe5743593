"""JSON fields, defaults for missing values, and identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.text import as_col


def json_field(raw: Column | str, path: str, type_name: str = "string") -> Column:
    """A JSON path as a typed column; what cannot be cast is null."""
    found = F.get_json_object(as_col(raw), path)
    return found if type_name == "string" else found.try_cast(type_name)


def num_or_zero(column: Column | str, type_name: str = "double") -> Column:
    return F.coalesce(as_col(column).try_cast(type_name), F.lit(0).cast(type_name))


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(as_col(column).cast("string"), F.lit(""))


def post_uri(did: Column | str, collection: Column | str, rkey: Column | str) -> Column:
    return F.concat(
        F.lit("at://"), as_col(did), F.lit("/"), as_col(collection), F.lit("/"), as_col(rkey)
    )


def root_author(uri: Column | str) -> Column:
    """Author part of a thread-root URI: ``none_error`` without one, ``error`` if the part
    after the five-character scheme has no slash."""
    uri = as_col(uri)
    parts = F.split(F.substr(uri, F.lit(6)), "/", 2)
    return (
        F.when(uri.isNull(), "none_error")
        .when(F.size(parts) == 2, F.get(parts, 0))
        .otherwise("error")
    )


def row_uid(run_id: Column | str, kind: str, key: Column | str) -> Column:
    """Row id that a replay computes again, so that loads are idempotent."""
    return F.sha2(
        F.concat_ws("|", as_col(run_id).cast("string"), F.lit(kind), as_col(key).cast("string")),
        256,
    )


def uuid5(namespace: str | uuid.UUID, name: Column | str) -> Column:
    """Name-based UUID (version 5) of a text column, without Python on the executors."""
    space = uuid.UUID(str(namespace)).hex
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(as_col(name), "UTF-8")))

    def part(start: int, length: int) -> Column:
        return F.substring(digest, start, length)

    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"),
        variant, part(18, 3), F.lit("-"), part(21, 12),
    )
