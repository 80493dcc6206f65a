"""The gateway: sources and their schemas in, queries answered as DataFrames."""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphweave.errors import ErrorRow, GraphError
from graphweave.functions.columns import error_frame
from graphweave.operators.lowering import FLAT, FUSED, ISOLATED, NESTED, Lowering
from graphweave.plans.analyze import Node, analyze
from graphweave.plans.catalog import SubGraph, SuperGraph
from graphweave.plans.planner import Plan, Planner
from graphweave.sources.binding import Many, One, Ref, SourceBinding
from graphweave.sources.pin import pin
from graphweave.sources.schema import load_schema
from graphweave.tracing import Tracer

KEPT_PLANS = 256


class Engine:
    """One generation: a composed graph with its bindings. Never changed once built."""

    def __init__(self, sdls: dict[str, str], bindings: dict[str, SourceBinding]):
        self.sdls, self.bindings = dict(sdls), dict(bindings)
        self.graph = SuperGraph([SubGraph(name, sdl) for name, sdl in sdls.items()])
        self.planner = Planner(self.graph, self._comes_as_stub, self._has_rows)
        self._plans: OrderedDict[tuple, Plan] = OrderedDict()
        self._lock = threading.Lock()

    def _comes_as_stub(self, source: str, type_name: str, field_name: str) -> bool:
        own = self.bindings.get(source)
        bound = own.types[type_name].of(field_name) if own and type_name in own.types else None
        return not isinstance(bound, (One, Many)) if bound is not None else True

    def _has_rows(self, source: str, type_name: str) -> bool:
        return source in self.bindings and type_name in self.bindings[source].types

    def plan(self, query: str, variables: dict[str, Any], operation: str | None) -> Plan:
        key = (query, operation, json.dumps(variables, sort_keys=True, default=str))
        with self._lock:
            if key in self._plans:
                self._plans.move_to_end(key)
                return self._plans[key]
            found = self.planner.plan(analyze(self.graph, query, variables, operation))
            self._plans[key] = found
            if len(self._plans) > KEPT_PLANS:
                self._plans.popitem(last=False)
            return found


@dataclass
class Response:
    """Answers by response key, and error rows. ``data`` is None if the query was refused."""

    spark: SparkSession
    data: dict[str, DataFrame] | None
    error_rows: list[ErrorRow] = field(default_factory=list)
    plan: Plan | None = None
    omitted: set[tuple[str, ...]] = field(default_factory=set)
    failed: set[str] = field(default_factory=set)
    reported: list[tuple[Callable[[], list[ErrorRow]], str, tuple[str, ...]]] = field(default_factory=list)

    @property
    def all_errors(self) -> list[ErrorRow]:
        """Those of planning and those that remote sources have met while what was computed so far was computed."""
        met = [ErrorRow(e.message, (*path, *e.path), {"serviceName": source} | e.extensions) for rows, source, path in self.reported for e in rows()]
        return [*self.error_rows, *sorted(met, key=lambda e: (e.path, e.message))]

    @property
    def errors(self) -> DataFrame:
        return error_frame(self.spark, self.all_errors)

    def __getitem__(self, key: str) -> DataFrame:
        if self.data is None:
            raise GraphError("; ".join(r.message for r in self.error_rows))
        return self.data[key]

    def to_dict(self) -> dict[str, Any]:
        """The whole answer as nested values, for answers that fit the driver; asks for the nested shape."""
        out: dict[str, Any] = {"data": None}
        if self.data is not None:
            out["data"] = {}
            for root in self.plan.roots:
                node = root.node
                rows = [] if node.key in self.failed else [r.asDict(recursive=True) for r in self.data[node.key].collect()]
                values = [self._shown(r, node) if node.is_object else r[node.key] for r in rows]
                out["data"][node.key] = values if node.is_list and node.key not in self.failed else (values[0] if values else None)
        if errors := self.all_errors:
            out["errors"] = [{"message": r.message, "path": list(r.path), "extensions": r.extensions} for r in errors]
        return out

    def _shown(self, value: Any, node: Node) -> Any:
        if value is None or not node.is_object:
            return value
        if isinstance(value, list):
            return [self._shown(v, node) for v in value]
        below = {n.key: n for nodes in node.by_type.values() for n in nodes}
        own = None
        if node.abstract:
            tag = next((n.key for n in below.values() if n.name == "__typename"), None)
            own = {n.key for n in node.by_type.get(value.get(tag), [])} if tag else None
        return {k: self._shown(v, below[k]) for k, v in value.items() if k in below and below[k].path not in self.omitted and (own is None or k in own)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


class Gateway:
    """Answers queries over sources; schemas can be replaced and put back while queries run."""

    def __init__(self, spark: SparkSession, sources: dict[str, tuple[Any, SourceBinding]], drain_timeout: float = 30.0, key_nulling: bool = True, tracing: bool = False, attempts: int = 1, timeout: float = 5.0):
        self.spark, self.drain_timeout, self.key_nulling = spark, drain_timeout, key_nulling
        self.attempts, self.timeout = attempts, timeout
        self.tracer = Tracer(spark, tracing)
        self._engine = Engine({n: load_schema(sdl, attempts, timeout) for n, (sdl, _) in sources.items()}, {n: b for n, (_, b) in sources.items()})
        self._previous: Engine | None = None
        self._updates = threading.Lock()
        self._idle = threading.Condition()
        self._running = 0

    @property
    def engine(self) -> Engine:
        return self._engine

    @property
    def graph(self) -> SuperGraph:
        return self._engine.graph

    # queries

    def execute(self, query: str, variables: dict[str, Any] | None = None, operation_name: str | None = None, shape: str = FLAT, mode: str = FUSED) -> Response:
        """Answers lie in lazy frames; the mode ``isolated`` computes each source's part at once, so that one that fails leaves the rest."""
        if shape not in (FLAT, NESTED) or mode not in (FUSED, ISOLATED):
            raise ValueError(f"unknown shape {shape} or mode {mode}")
        with self._idle:
            self._running += 1
            engine = self._engine
        try:
            with self.tracer.span("plan", query[:80]):
                plan = engine.plan(query, variables or {}, operation_name)
            low = Lowering(self.spark, engine.graph, engine.bindings, shape, mode, self.key_nulling)
            data, failed = {}, set()
            for root in plan.roots:
                before = len(low.errors)
                with self.tracer.span("root", root.node.name):
                    frame = low.root(root)
                    # mutations run one after another, each to its end
                    data[root.node.key] = pin(frame) if plan.kind == "mutation" else frame
                if any(not e.path for e in low.errors[before:]):
                    failed.add(root.node.key)
            return Response(self.spark, data, low.errors, plan, low.omitted, failed, low.reported)
        except GraphError as e:
            return Response(self.spark, None, e.rows)
        finally:
            with self._idle:
                self._running -= 1
                self._idle.notify_all()

    def explain(self, query: str, variables: dict[str, Any] | None = None, operation_name: str | None = None) -> str:
        """The steps, then each root's physical plan."""
        plan = self._engine.plan(query, variables or {}, operation_name)
        lines = ["id | kind | source | type | path | fields | keys | depends"]
        for s in plan.steps:
            lines.append(" | ".join([str(s.id), s.kind, s.source, s.type, ".".join(s.path), " ".join(s.fields), " ".join(s.keys), " ".join(map(str, s.depends))]))
        for key, frame in (self.execute(query, variables, operation_name).data or {}).items():
            lines.append(f"\n{key}:\n" + frame._jdf.queryExecution().toString())
        return "\n".join(lines)

    # schema updates

    def apply(self, name: str, sdl: Any, binding: SourceBinding | None = None) -> None:
        """Replaces a known source's schema (and binding). A schema that doesn't compose leaves all as it was.

        Queries that are running keep the generation they began with; the swap waits for them, but
        no longer than ``drain_timeout``.
        """
        with self._updates:
            engine = self._engine
            if name not in engine.sdls:
                raise GraphError(f"no source is called {name}")
            after = Engine(engine.sdls | {name: load_schema(sdl, self.attempts, self.timeout)}, engine.bindings | ({name: binding} if binding else {}))
            self._drain()
            self._previous, self._engine = engine, after

    def rollback(self) -> None:
        """Puts the generation before the last update back."""
        with self._updates:
            if self._previous is None:
                raise GraphError("there is no earlier schema")
            self._engine, self._previous = self._previous, None

    def _drain(self) -> None:
        until = time.monotonic() + self.drain_timeout
        with self._idle:
            while self._running and (left := until - time.monotonic()) > 0:
                self._idle.wait(left)


Factory = Callable[[SparkSession], Gateway]
