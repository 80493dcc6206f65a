"""Configuration files: sources with their schemas, tables and root fields.

    service_name: example
    drain_timeout: 30s
    shape: flat
    mode: fused
    opentelemetry: {tracing: {enable: false}}
    services:
      - name: products
        sdl: products.graphql            # a file, a text, or an http address
        retry: {attempts: 3, timeout: 5s}
        tables:
          Product: {path: products.parquet, format: parquet, columns: {id: product_id}}
        lists:
          Product.reviews: {by: {id: product_id}, order_by: [review_id]}
        references:
          Review.product: {by: {id: product_id}, provides: {name: product_name}}
        roots:
          product: {filters: {id: product_id}}
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphweave.errors import GraphError
from graphweave.gateway import Gateway
from graphweave.sources.binding import Many, Ref, Root, SourceBinding, TypeBinding
from graphweave.sources.schema import load_schema

SAMPLE = """\
service_name: example
drain_timeout: 30s
services:
  - name: products
    sdl: products.graphql
    tables:
      Product: {path: products.parquet, columns: {id: product_id}}
    roots:
      product: {filters: {id: product_id}}
  - name: reviews
    sdl: reviews.graphql
    tables:
      Review: {path: reviews.parquet, columns: {id: review_id}}
      Product: {path: products.parquet, columns: {id: product_id}}
    lists:
      Product.reviews: {by: {id: product_id}, order_by: [review_id]}
"""
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(value: Any) -> float:
    """Durations such as 30s, 1m30s or 500ms; plain numbers are seconds."""
    if isinstance(value, (int, float)):
        return float(value)
    if not re.fullmatch(r"(\d+(?:\.\d+)?(?:ms|s|m|h))+", str(value)):
        raise GraphError(f"{value!r} is not a duration")
    return sum(float(n) * UNITS[unit] for n, unit in re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", str(value)))


def parse(text: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:  # configuration files alone need it
        raise GraphError("configuration files need PyYAML") from e
    return yaml.safe_load(text) or {}


def _located(base: Path, where: str) -> str:
    return where if re.match(r"[a-z0-9]+:/|/", where) else str(base / where)


def _binding(spark: SparkSession, base: Path, service: dict[str, Any]) -> SourceBinding:
    def reader(spec: dict[str, Any]):
        def read() -> DataFrame:
            return spark.read.format(spec.get("format", "parquet")).options(**spec.get("options", {})).load(_located(base, spec["path"]))

        return read

    types = {name: TypeBinding(reader(spec), dict(spec.get("columns", {}))) for name, spec in service.get("tables", {}).items()}

    def bind(where: str, bound: Any) -> None:
        type_name, _, field = where.partition(".")
        if type_name not in types:
            raise GraphError(f"{service['name']}: {where} needs a table of {type_name}")
        types[type_name].fields[field] = bound

    for where, spec in service.get("lists", {}).items():
        bind(where, Many(spec["by"], spec.get("order_by", []), spec.get("filters", {})))
    for where, spec in service.get("references", {}).items():
        bind(where, Ref(spec["by"], spec.get("provides", {})))
    roots = {name: Root(spec.get("filters", {}), order_by=spec.get("order_by", [])) for name, spec in service.get("roots", {}).items()}
    return SourceBinding(types, roots)


def load(spark: SparkSession, path: str) -> tuple[Gateway, dict[str, Any]]:
    """The gateway that the file describes, and the file's settings."""
    base = Path(path).resolve().parent
    settings = parse(Path(path).read_text(encoding="utf-8"))
    services = settings.get("services") or []
    if not services:
        raise GraphError(f"{path} names no services")
    sources = {}
    for service in services:
        retry = service.get("retry", {})
        sdl = service["sdl"]
        local = "{" not in sdl and not sdl.startswith(("http://", "https://"))
        text = load_schema(Path(_located(base, sdl)) if local else sdl, retry.get("attempts", 1), seconds(retry.get("timeout", 5)))
        sources[service["name"]] = text, _binding(spark, base, service)
    tracing = settings.get("opentelemetry", {}).get("tracing", {}).get("enable", False)
    return Gateway(spark, sources, seconds(settings.get("drain_timeout", 30)), tracing=tracing), settings
