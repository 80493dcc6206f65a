"""Remote services as sources: root fields and batched entity look-ups over HTTP, from the executors.

A service answers POSTed ``{query, variables}`` with ``{data, errors}``. Entities are asked for by
their keys, many in one request, through ``_entities(representations: …)``. Requests run in
``mapInPandas`` on the executors, so their number, not the driver, bounds the throughput; keys are
distinct before they are sent. Errors that come with data are kept beside it. In fused mode a
request that fails leaves nulls and its errors, which are known once the answer is computed.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Sequence
from functools import partial
from typing import Any

import pandas as pd
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphweave.errors import ErrorRow, SourceError
from graphweave.sources.binding import Lookup, Root


def ask(url: str, query: str, variables: dict[str, Any], timeout: float = 30.0, attempts: int = 1) -> tuple[dict[str, Any], list[ErrorRow]]:
    """The answer's data and the errors that came with it; errors without any data are the source's failure."""
    body = json.dumps({"query": query, "variables": variables}, default=str).encode()
    for left in range(max(1, attempts) - 1, -1, -1):
        try:
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                found = json.load(answer)
            break
        except OSError:
            if not left:
                raise
    errors = [ErrorRow(str(e.get("message")), tuple(map(str, e.get("path") or ())), {k: str(v) for k, v in (e.get("extensions") or {}).items()}) for e in found.get("errors") or ()]
    if errors and not found.get("data"):
        raise SourceError(*errors)
    return found.get("data") or {}, errors


class _Reports(AccumulatorParam):
    """Error rows of the executors, each kept once however often a task is tried."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, one: dict, other: dict) -> dict:
        one.update(other)
        return one


def _report(row: ErrorRow) -> dict:
    # the path leads through the protocol's own field and a place in the request
    path = tuple(p for p in row.path if p != "_entities" and not p.isdigit())
    return {(row.message, path, tuple(sorted(row.extensions.items()))): True}


def _selection(kind: T.DataType) -> str:
    """The selections that a Spark type asks for below a field."""
    if isinstance(kind, T.ArrayType):
        return _selection(kind.elementType)
    if isinstance(kind, T.StructType):
        return " { " + " ".join(f.name + _selection(f.dataType) for f in kind.fields) + " }"
    return ""


def _shaped(value: Any, kind: T.DataType) -> Any:
    """A JSON value as the Spark type wants it; fields that are missing are null."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.StringType):
        return str(value)
    return float(value) if isinstance(kind, T.DoubleType) else value


def entities(url: str, type_name: str, schema: T.StructType, batch: int = 500, timeout: float = 30.0, attempts: int = 1) -> Lookup:
    """A type whose rows are looked up by key; ``schema`` has all its fields, keys too."""

    def look_up(keys: DataFrame, fields: Sequence[str], lenient: bool = False) -> DataFrame:
        reports = keys.sparkSession.sparkContext.accumulator({}, _Reports())
        names = list(keys.columns)
        wanted = [schema[f] for f in dict.fromkeys(fields) if f not in names]
        out = T.StructType([*keys.schema.fields, *wanted])
        selection = " ".join(f.name + _selection(f.dataType) for f in wanted)
        query = f"query ($representations: [_Any!]!) {{ _entities(representations: $representations) {{ ... on {type_name} {{ __typename {selection} }} }} }}"

        def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for start in range(0, len(part), batch):
                    own = part.iloc[start : start + batch]
                    asked = [{"__typename": type_name} | row for row in own.to_dict("records")]
                    try:
                        data, errors = ask(url, query, {"representations": asked}, timeout, attempts)
                        found = data.get("_entities") or []
                        if len(found) != len(asked):
                            raise SourceError(ErrorRow(f"{len(asked)} objects were asked for, {len(found)} came"))
                    except (SourceError, OSError, ValueError) as e:
                        if not lenient:
                            raise
                        found = [None] * len(asked)
                        errors = e.rows if isinstance(e, SourceError) else [ErrorRow(str(e) or type(e).__name__)]
                    for row in errors:
                        reports.add(_report(row))
                    yield pd.DataFrame({n: own[n].tolist() for n in names} | {f.name: [_shaped((e or {}).get(f.name), f.dataType) for e in found] for f in wanted}, dtype=object)

        rows = keys.mapInPandas(fetch, out)
        rows.reported = lambda: [ErrorRow(message, path, dict(extensions)) for message, path, extensions in reports.value]
        return rows

    return Lookup(look_up, lenient=partial(look_up, lenient=True))


def root(spark: SparkSession, url: str, field: str, schema: T.StructType, arguments: dict[str, str] | None = None, timeout: float = 30.0, attempts: int = 1) -> Root:
    """A root field: asked for once, with the arguments' types as the service declares them."""

    def rows(args: dict[str, Any]) -> tuple[DataFrame, list[ErrorRow]]:
        given = {a: kind for a, kind in (arguments or {}).items() if a in args}
        header = "query (" + ", ".join(f"${a}: {kind}" for a, kind in given.items()) + ") " if given else ""
        inner = "(" + ", ".join(f"{a}: ${a}" for a in given) + ")" if given else ""
        data, errors = ask(url, f"{header}{{ {field}{inner}{_selection(schema)} }}", {a: args[a] for a in given}, timeout, attempts)
        found = data.get(field)
        found = found if isinstance(found, list) else [found]
        return spark.createDataFrame([_shaped(r, schema) for r in found if r is not None], schema), errors

    return Root(rows=rows)
