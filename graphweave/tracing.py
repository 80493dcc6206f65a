"""Spans of planning and of each root, shown as job descriptions in Spark's own tools."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Span:
    name: str
    detail: str
    began: float
    seconds: float
    failed: bool


class Tracer:
    def __init__(self, spark: SparkSession, enable: bool = False, kept: int = 1000):
        self.spark, self.enable, self.kept = spark, enable, kept
        self.spans: list[Span] = []

    @contextmanager
    def span(self, name: str, detail: str = "") -> Iterator[None]:
        if not self.enable:
            yield
            return
        began, failed = time.time(), True
        self.spark.sparkContext.setJobDescription(f"{name}: {detail}")
        try:
            yield
            failed = False
        finally:
            self.spark.sparkContext.setJobDescription(None)
            self.spans = [*self.spans[-self.kept + 1 :], Span(name, detail, began, time.time() - began, failed)]
