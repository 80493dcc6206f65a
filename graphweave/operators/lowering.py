"""From a plan to one lazy DataFrame for each root field.

Objects are built from below. A base table is narrowed to the columns that are asked for; fields
of other sources come by left equi-joins on the key; references by left joins on the foreign key;
lists, in nested shape, are gathered by parent key before they are joined, so that no level is
exploded and gathered again. In flat shape lists multiply rows, so at most one list may stand
beside others at a level.

A source that fails while its frame is built (or, in isolated mode, computed) leaves typed nulls
and error rows; the other sources' fields stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.errors import ErrorRow, GraphError, SourceError
from graphweave.functions.columns import equals, null, spark_type
from graphweave.plans.analyze import TYPENAME, Node
from graphweave.plans.catalog import SuperGraph
from graphweave.plans.planner import Join, ObjectPlan, RootPlan
from graphweave.sources.binding import Compute, Lookup, Many, Nested, One, Ref, Root, SourceBinding, TypeBinding
from graphweave.sources.pin import pin

FLAT, NESTED = "flat", "nested"
FUSED, ISOLATED = "fused", "isolated"
#: Key columns of these names keep their values when a step that uses them fails.
KEPT_KEYS = {"id", "_id", TYPENAME}


@dataclass
class Built:
    """Rows of objects: output columns by path (flat) or one ``value`` column (nested); ``fans``: a list multiplies them."""

    df: DataFrame
    columns: list[tuple[tuple[str, ...], str]]
    value: str
    fans: bool = False


class StepFailed(Exception):
    def __init__(self, source: str, cause: Exception):
        super().__init__(str(cause))
        self.source, self.cause = source, cause


class Lowering:
    def __init__(self, spark: SparkSession, graph: SuperGraph, bindings: dict[str, SourceBinding], shape: str = FLAT, mode: str = FUSED, key_nulling: bool = True):
        self.spark, self.graph, self.bindings = spark, graph, bindings
        self.shape, self.mode, self.key_nulling = shape, mode, key_nulling
        self.errors: list[ErrorRow] = []
        #: Paths that are absent, rather than null, in a JSON answer.
        self.omitted: set[tuple[str, ...]] = set()
        #: Errors that look-ups meet while they run: what gives them, the source, and the path of its objects.
        self.reported: list[tuple[Callable[[], list[ErrorRow]], str, tuple[str, ...]]] = []

    # roots

    def root(self, plan: RootPlan) -> DataFrame:
        """Scalar roots give one column named by the response key; object roots one column for each leaf (flat) or field (nested)."""
        node = plan.node
        try:
            if not node.is_object:
                rows = self._root_rows(plan, self._roots(plan.source, node.name), node.type, None)
                return rows.select(F.col(rows.columns[0]).alias(node.key))
            parts = [self._finished(self._root_part(plan, t, own), node) for t, own in plan.objects.items()]
        except StepFailed as failure:
            self._report(failure, (), [()])
            return self.spark.createDataFrame([], self._schema(node))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def _roots(self, source: str, name: str) -> Root | dict[str, Root]:
        return self.bindings[source].roots.get(name, Root())

    def _root_part(self, plan: RootPlan, type_name: str, own: ObjectPlan) -> Built:
        binding = self._roots(plan.source, plan.node.name)
        binding = binding.get(type_name, Root(rows=None)) if isinstance(binding, dict) else binding
        order = {f"_order{k}": F.col(c) for k, c in enumerate(binding.order_by)}
        built = self.build(plan.node, own, order, self._root_rows(plan, binding, type_name, own))
        if order:
            built.df = built.df.orderBy(*order)
        return built

    def _root_rows(self, plan: RootPlan, binding: Root, type_name: str, own: ObjectPlan | None) -> DataFrame:
        def rows() -> DataFrame:
            if binding.rows is not None:
                found = binding.rows(plan.node.args)
                if isinstance(found, tuple):
                    found, errors = found
                    # the source's path begins with its own field
                    self.errors += [ErrorRow(e.message, (*plan.node.path, *e.path[1:]), {"serviceName": plan.source} | e.extensions) for e in errors]
                return found
            df = self.bindings[plan.source].type(type_name).frame()
            return self._filtered(df, binding.filters, plan.node.args)

        return self._attempt(plan.source, rows, pinned=own is None)

    @staticmethod
    def _filtered(df: DataFrame, filters: dict[str, str], args: dict) -> DataFrame:
        for arg, column in filters.items():
            if args.get(arg) is not None:
                df = df.where(equals(F.col(column), df.schema[column].dataType, args[arg]))
        return df

    def _finished(self, built: Built, node: Node) -> DataFrame:
        if self.shape == NESTED:
            return built.df.select(f"{built.value}.*")
        return built.df.select(*[F.col(f"`{c}`").alias(flat_name(path[1:])) for path, c in built.columns])

    # failures

    def _attempt(self, source: str, make, pinned: bool = True) -> DataFrame:
        """The frame of ``make``; in isolated mode it is computed here if ``pinned``, else once its columns have been narrowed."""
        try:
            df = make()
            df.schema  # noqa: B018 - analysis fails here, not later
            return pin(df) if pinned and self.mode == ISOLATED else df
        except (StepFailed, GraphError) as e:
            raise (StepFailed(source, e) if isinstance(e, SourceError) else e) from e
        except Exception as e:
            raise StepFailed(source, e) from e

    def _report(self, failure: StepFailed, prefix: tuple[str, ...], paths: Iterable[tuple[str, ...]]) -> None:
        extensions = {"serviceName": failure.source}
        if isinstance(failure.cause, SourceError):
            self.errors += [ErrorRow(r.message, (*prefix, *r.path), extensions | r.extensions) for r in failure.cause.rows]
        else:
            message = str(failure.cause).splitlines()[0] if str(failure.cause) else type(failure.cause).__name__
            self.errors += [ErrorRow(message, path, extensions) for path in paths]

    # types of what failed

    def _field_type(self, node: Node) -> T.DataType:
        if not node.is_object:
            return T.StringType() if node.name == TYPENAME else spark_type(self.graph.field(node.parent_type, node.name).type)
        fields: dict[str, T.DataType] = {}
        for below in node.by_type.values():
            fields |= {c.key: self._field_type(c) for c in below}
        kind = T.StructType([T.StructField(k, t) for k, t in fields.items()])
        return T.ArrayType(kind) if node.is_list else kind

    def _leaves(self, node: Node) -> list[tuple[tuple[str, ...], T.DataType]]:
        if not node.is_object:
            return [(node.path, self._field_type(node))]
        return list({leaf[0]: leaf for below in node.by_type.values() for c in below for leaf in self._leaves(c)}.values())

    def _schema(self, node: Node) -> T.StructType:
        if not node.is_object:
            return T.StructType([T.StructField(node.key, self._field_type(node))])
        if self.shape == NESTED:
            kind = self._field_type(node)
            return kind.elementType if node.is_list else kind
        return T.StructType([T.StructField(flat_name(path[1:]), kind) for path, kind in self._leaves(node)])

    # objects

    def build(self, node: Node, own: ObjectPlan, need: dict[str, Column], start: DataFrame | None = None) -> Built:
        """The objects of ``own`` with their selections, and the columns ``need`` of the base table by alias."""
        base = start if start is not None else self._attempt(own.base, self.bindings[own.base].type(own.type).frame, pinned=False)
        return ObjectBuilder(self, node, own).run(base, need)


def flat_name(path: tuple[str, ...]) -> str:
    return "__".join(path)


def _narrower(narrowed: Callable[[Column, Node], Column], of: Node) -> Callable[[Column], Column]:
    return lambda x: narrowed(x, of)


def looked_up(low: Lowering, source: str, path: tuple[str, ...], own: Lookup, df: DataFrame, keys: dict[str, Column], fields: list[str]) -> DataFrame:
    """Rows of a source that finds objects by key: each key is asked for once."""
    asked = df.select(*[c.alias(k) for k, c in keys.items()]).na.drop().distinct()
    columns = [b.column if isinstance(b := own.of(f), Nested) else f for f in fields]
    find = own.lenient if own.lenient and low.mode == FUSED else own.look_up
    rows = find(asked, [c for c in dict.fromkeys(columns) if c not in keys])
    if hasattr(rows, "reported"):
        low.reported.append((rows.reported, source, path))
    return rows


class ObjectBuilder:
    """One object type at one place of the tree."""

    def __init__(self, lowering: Lowering, node: Node, own: ObjectPlan):
        self.low, self.node, self.own = lowering, node, own
        self.prefix = f"_{node.id}_{own.type}"
        self.nulled: set[str] = set()
        self.outputs: dict[int, list[tuple[tuple[str, ...], str]]] = {}
        self.fans = False

    # names and bindings

    def name(self, source: str, field: str) -> str:
        join = self.own.join(source)
        if join and field in join.keys:
            return self.name(join.via, field)
        return f"{self.prefix}_{source}_{field}"

    def binding(self, source: str) -> TypeBinding | None:
        return self.low.bindings[source].types.get(self.own.type)

    def bound(self, source: str, field: str):
        own = self.binding(source)
        return own.of(field) if own else field

    def column(self, source: str, field: str) -> Column:
        bound = self.bound(source, field)
        return F.col(bound) if isinstance(bound, str) else bound

    # columns that a source's table has to give

    def _demand(self) -> dict[str, dict[str, Column]]:
        """By source: alias -> column of its table."""
        own, demand = self.own, {self.own.base: {}, **{j.source: {} for j in self.own.joins}}

        def plain(source: str, field: str) -> None:
            join = own.join(source)
            if join and field in join.keys:
                plain(join.via, field)
            else:
                demand[source][self.name(source, field)] = self.column(source, field)

        def wanted(source: str, field: str, node: Node | None) -> None:
            bound = self.bound(source, field)
            if isinstance(bound, Ref):
                demand[source] |= {f"{self.prefix}_{source}_{field}@{k}": F.col(c) for k, c in {**bound.on, **bound.provides}.items()}
            elif isinstance(bound, (Many, One)):
                for key in bound.on:
                    plain(source, key)
            elif isinstance(bound, Compute):
                demand[source] |= {f"{self.prefix}_{source}_{c}": F.col(c) for c in bound.own}
                for item in own.requires.get((source, field), ()):
                    if not isinstance(self.bound(own.where[item], item), Compute):
                        plain(own.where[item], item)
            elif isinstance(bound, Nested):
                demand[source][self.name(source, field)] = F.col(bound.column)
            else:
                plain(source, field)

        for source, nodes, hidden in [(own.base, own.local, own.hidden), *[(j.source, j.nodes, j.hidden) for j in own.joins]]:
            for node in nodes:
                wanted(source, node.name, node)
            for field in hidden:
                wanted(source, field, None)
        for join in own.joins:
            for key in join.keys:
                plain(join.via, key)
        return demand

    def run(self, base: DataFrame, need: dict[str, Column]) -> Built:
        own = self.own
        demand = self._demand()
        constant = f"{self.prefix}_here"
        take = {**demand[own.base], **need}
        try:
            df = base.select(*[c.alias(a) for a, c in take.items()]) if take else base.select(F.lit(True).alias(constant))
            df = pin(df) if self.low.mode == ISOLATED else df
        except Exception as e:
            raise StepFailed(own.base, e) from e
        failed: set[str] = set()
        for join in own.joins:
            df = self._joined(df, join, demand[join.source], failed)
        df = self._computed(df, failed)
        for source, node in [(own.base, n) for n in own.local] + [(j.source, n) for j in own.joins for n in j.nodes]:
            if source in failed:
                df = self._nothing(df, node)
            elif node.is_object:
                df = self._child(df, source, node)
            else:
                self.outputs[node.id] = [(node.path, self.name(source, node.name))]
        for node in own.typenames:
            alias = f"{self.prefix}_{node.key}_type"
            df = df.withColumn(alias, F.lit(own.type))
            self.outputs[node.id] = [(node.path, alias)]
        return self._assembled(df, need)

    def _assembled(self, df: DataFrame, need: dict[str, Column]) -> Built:
        own, children = self.own, [n for n in self.node.by_type[self.own.type] if n.id in self.outputs]
        for node in children:
            if node.name in self.nulled and not node.is_object:
                alias = f"{self.prefix}_{node.key}_nulled"
                df = df.withColumn(alias, null(df.schema[self.outputs[node.id][0][1]].dataType))
                self.outputs[node.id] = [(node.path, alias)]
        if self.low.shape == FLAT:
            columns = [c for n in children for c in self.outputs[n.id]]
            return Built(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*[c for _, c in columns], *need])]), columns, "", self.fans)
        value = f"{self.prefix}_value"
        fields = [F.col(f"`{self.outputs[n.id][0][1]}`").alias(n.key) for n in children]
        content = F.struct(*fields) if fields else F.struct(F.lit(own.type).alias(TYPENAME))
        return Built(df.select(content.alias(value), *need), [], value)

    # other sources

    def _joined(self, df: DataFrame, join: Join, demand: dict[str, Column], failed: set[str]) -> DataFrame:
        if not demand:  # only lists and computed fields: they need no row of this source's own
            return df
        keys = {f"{self.prefix}_{join.source}_k_{k}": k for k in join.keys}

        def rows() -> DataFrame:
            own = self.low.bindings[join.source].type(self.own.type)
            if isinstance(own, Lookup):
                table = looked_up(self.low, join.source, self.node.path, own, df, {k: F.col(f"`{self.name(join.via, k)}`") for k in join.keys}, [n.name for n in join.nodes] + join.hidden)
            else:
                table = own.frame()
            return table.select(*[self.column(join.source, k).alias(a) for a, k in keys.items()], *[c.alias(a) for a, c in demand.items()])

        try:
            right = self.low._attempt(join.source, rows)
        except StepFailed as failure:
            self._step_failed(failure, join, [n for n in join.nodes])
            failed.add(join.source)
            for alias in demand:
                df = df.withColumn(alias, F.lit(None).cast("string"))
            return df
        condition = [F.col(f"`{self.name(join.via, k)}`") == F.col(f"`{a}`") for a, k in keys.items()]
        return df.join(right, condition, "left").drop(*keys)

    def _step_failed(self, failure: StepFailed, join: Join | None, nodes: list[Node]) -> None:
        """Errors for each field of the step; its keys are lost with it unless their name keeps them."""
        here = self.node.path
        lost = [k for k in join.keys if k not in KEPT_KEYS] if join and self.low.key_nulling else []
        self.nulled |= set(lost)
        self.low._report(failure, here, [(*here, k) for k in lost] + [n.path for n in nodes if n.name != TYPENAME])
        if self.node.is_list and join:
            self.low.omitted |= {n.path for n in nodes}

    def _nothing(self, df: DataFrame, node: Node) -> DataFrame:
        """Typed nulls for a field and all below it."""
        if self.low.shape == NESTED or not node.is_object:
            leaves = [(node.path, self.low._field_type(node))]
        else:
            leaves = self.low._leaves(node)
        out = []
        for path, kind in leaves:
            alias = f"{self.prefix}_{flat_name(path)}_null"
            df = df.withColumn(alias, null(kind))
            out.append((path, alias))
        self.outputs[node.id] = out
        return df

    # computed fields

    def _computed(self, df: DataFrame, failed: set[str]) -> DataFrame:
        own = self.own
        args = {(own.where.get(n.name), n.name): n.args for n in [*own.local, *[n for j in own.joins for n in j.nodes]]}
        wanted = dict.fromkeys([*own.order, *args, *[(own.base, h) for h in own.hidden], *[(j.source, h) for j in own.joins for h in j.hidden]])
        for source, field in wanted:
            bound = self.bound(source, field)
            if not isinstance(bound, Compute) or source in failed:
                continue
            inputs = {item: F.col(f"`{self.name(own.where[item], item)}`") for item in own.requires.get((source, field), ())}
            inputs |= {c: F.col(f"`{self.prefix}_{source}_{c}`") for c in bound.own}
            df = df.withColumn(self.name(source, field), bound.function(inputs, args.get((source, field), {})))
        return df

    # objects below

    def _child(self, df: DataFrame, source: str, node: Node) -> DataFrame:
        if node.abstract:
            raise GraphError(f"{node.parent_type}.{node.name}: unions and interfaces are supported at the root", node.path)
        bound, plan = self.bound(source, node.name), self.own.below[node.id][node.type]
        try:
            if isinstance(bound, Ref):
                return self._reference(df, source, node, bound, plan)
            if isinstance(bound, (Many, One)):
                return self._rows_below(df, source, node, bound, plan)
            if isinstance(bound, Nested):
                return self._nested(df, source, node, plan)
        except StepFailed as failure:
            join = self.own.join(source)
            if failure.source == source:
                self._step_failed(failure, join, [node])
            else:
                self.low._report(failure, node.path, [node.path])
            return self._nothing(df, node)
        raise GraphError(f"{node.parent_type}.{node.name} of {source} is bound to a column, but it is an object", node.path)

    def _reference(self, df: DataFrame, source: str, node: Node, bound: Ref, plan: ObjectPlan) -> DataFrame:
        """The object is there if its foreign key is; keys and provided fields come with it."""
        at = lambda field: F.col(f"`{self.prefix}_{source}_{node.name}@{field}`")
        there = F.lit(True)
        for key in bound.on:
            there = there & at(key).isNotNull()
        stub = {n.id: at(n.name) for n in plan.stub_nodes if n.name in bound.on or n.name in bound.provides}
        stub |= {n.id: F.when(there, F.lit(node.type)) for n in plan.typenames}
        children = node.children
        built = None
        if plan.base is not None:
            need = {f"_{node.id}_to_{k}": self._of(plan, k) for k in plan.stub_keys}
            far, start = self.low.bindings[plan.base].types.get(plan.type), None
            try:
                if isinstance(far, Lookup):
                    wanted = [n.name for n in plan.local] + plan.hidden + [k for j in plan.joins for k in j.keys]
                    start = self.low._attempt(plan.base, lambda: looked_up(self.low, plan.base, node.path, far, df, {k: at(k) for k in plan.stub_keys}, wanted))
                built = self.low.build(node, plan, need, start)
            except StepFailed as failure:
                keys = [k for k in plan.stub_keys if k not in KEPT_KEYS] if self.low.key_nulling else []
                rest = [n for n in children if n.id not in stub]
                self.low._report(failure, node.path, [(*node.path, k) for k in keys] + [n.path for n in rest])
                stub = {i: c for i, c in stub.items() if not any(n.id == i and n.name in keys for n in children)}
        if built is not None:
            right = self.low._attempt(plan.base, lambda: built.df) if self.low.mode == ISOLATED else built.df
            df = df.join(right, [at(k) == F.col(f"`_{node.id}_to_{k}`") for k in plan.stub_keys], "left")
            self.fans |= built.fans
        if self.low.shape == NESTED:
            fields = []
            for n in children:
                if n.id in stub:
                    fields.append(stub[n.id].alias(n.key))
                elif built is not None:
                    fields.append(F.col(built.value)[n.key].alias(n.key))
                else:
                    fields.append(null(self.low._field_type(n)).alias(n.key))
            alias = f"{self.prefix}_{node.key}_object"
            df = df.withColumn(alias, F.when(there, F.struct(*fields)))
            self.outputs[node.id] = [(node.path, alias)]
            return df.drop(*([built.value] if built is not None else []))
        out = []
        of_built = dict(built.columns) if built is not None else {}
        for n in children:
            if n.id in stub:
                alias = f"{self.prefix}_{flat_name(n.path)}_stub"
                df = df.withColumn(alias, stub[n.id])
                out.append((n.path, alias))
                continue
            for path, kind in self.low._leaves(n):
                alias = of_built.get(path)
                if alias is None:
                    alias = f"{self.prefix}_{flat_name(path)}_null"
                    df = df.withColumn(alias, null(kind))
                out.append((path, alias))
        self.outputs[node.id] = out
        return df

    def _nested(self, df: DataFrame, source: str, node: Node, plan: ObjectPlan) -> DataFrame:
        """Objects within a column: narrowed in place, or one row each in flat shape."""
        if plan.joins:
            raise GraphError(f"{node.parent_type}.{node.name} arrives nested and can't be joined; explode it in the binding", node.path)
        column = F.col(f"`{self.name(source, node.name)}`")

        def narrowed(item: Column, of: Node) -> Column:
            fields = []
            for n in of.children:
                if n.name == TYPENAME:
                    fields.append(F.lit(of.type).alias(n.key))
                elif n.is_object:
                    inner = F.transform(item[n.name], _narrower(narrowed, n)) if n.is_list else F.when(item[n.name].isNotNull(), narrowed(item[n.name], n))
                    fields.append(inner.alias(n.key))
                else:
                    fields.append(item[n.name].alias(n.key))
            return F.struct(*fields)

        alias = f"{self.prefix}_{node.key}_nested"
        value = F.transform(column, lambda x: narrowed(x, node)) if node.is_list else F.when(column.isNotNull(), narrowed(column, node))
        df = df.withColumn(alias, value)
        if self.low.shape == NESTED:
            self.outputs[node.id] = [(node.path, alias)]
            return df
        out: list[tuple[tuple[str, ...], str]] = []

        def flattened(df: DataFrame, of: Node, name: str) -> DataFrame:
            if of.is_list:
                if self.fans:
                    raise GraphError("two lists side by side multiply each other in flat shape; ask for the nested shape", of.path)
                self.fans = True
                df = df.withColumn(name, F.explode_outer(F.col(f"`{name}`")))
            for n in of.children:
                leaf = f"{self.prefix}_{flat_name(n.path)}_leaf"
                df = df.withColumn(leaf, F.col(f"`{name}`")[n.key])
                if n.is_object:
                    df = flattened(df, n, leaf)
                else:
                    out.append((n.path, leaf))
            return df

        df = flattened(df, node, alias)
        self.outputs[node.id] = out
        return df

    def _of(self, plan: ObjectPlan, field: str) -> Column:
        bound = self.low.bindings[plan.base].type(plan.type).of(field)
        return F.col(bound) if isinstance(bound, str) else bound

    def _rows_below(self, df: DataFrame, source: str, node: Node, bound: Many | One, plan: ObjectPlan) -> DataFrame:
        keys = {f"_{node.id}_of_{k}": (k, c) for k, c in bound.on.items()}
        order = {f"_{node.id}_order_{k}": F.col(c) for k, c in enumerate(bound.order_by)} if isinstance(bound, Many) and self.low.shape == NESTED else {}

        def rows() -> DataFrame:
            table = self.low.bindings[source].type(node.type).frame()
            return self.low._filtered(table, bound.filters, node.args)

        start = self.low._attempt(source, rows, pinned=False)
        built = self.low.build(node, plan, {a: F.col(c) for a, (_, c) in keys.items()} | order, start)
        condition = [F.col(f"`{self.name(source, k)}`") == F.col(f"`{a}`") for a, (k, _) in keys.items()]
        if self.low.shape == FLAT:
            if isinstance(bound, Many) or built.fans:
                if self.fans:
                    raise GraphError("two lists side by side multiply each other in flat shape; ask for the nested shape", node.path)
                self.fans = True
            df = df.join(built.df, condition, "left").drop(*keys)
            self.outputs[node.id] = built.columns
            return df
        alias = f"{self.prefix}_{node.key}_below"
        if isinstance(bound, One):
            df = df.join(built.df.withColumnRenamed(built.value, alias), condition, "left").drop(*keys)
        else:
            gathered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(built.value).alias("value")))), lambda x: x["value"])
            lists = built.df.groupBy(*keys).agg(gathered.alias(alias))
            kind = lists.schema[alias].dataType
            df = df.join(lists, condition, "left").drop(*keys).withColumn(alias, F.coalesce(F.col(alias), F.array().cast(kind)))
        self.outputs[node.id] = [(node.path, alias)]
        return df
