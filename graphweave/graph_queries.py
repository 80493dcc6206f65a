"""Queries over the test graph, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphweave import testgraph
from graphweave.gateway import Gateway
from graphweave.sources import remote
from graphweave.sources.binding import Root, SourceBinding, TypeBinding
from graphweave.sources.pin import shared_dir
from graphweave.streaming.subscription import subscribe


@dataclass(frozen=True)
class Case:
    """A graph query over one root, and its SQL."""

    query: str
    sql: str
    variables: dict[str, Any] = field(default_factory=dict)
    root: str | None = None
    down: tuple[str, ...] = ()
    mode: str = "fused"
    key_nulling: bool = True

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        response = testgraph.build(spark, sf_dir, self.down, key_nulling=self.key_nulling).execute(self.query, self.variables, mode=self.mode)
        return response[self.root or next(iter(response.data or {"": None}))]


FLAGSHIP = "{ customers { name nation { name region { name } } orders { orderKey totalPrice taxEstimate lineItems { quantity part { name } } } } }"

CASES: dict[str, Case] = {
    "root_by_key": Case("{ customer(custKey: 5) { custKey name balance } }", "select c_custkey as \"custKey\", c_name as name, c_acctbal as balance from customer where c_custkey = 5"),
    "root_list": Case("{ nations { nationKey name } }", 'select n_nationkey as "nationKey", n_name as name from nation'),
    "variables_composite": Case(
        "query One($u: ID!, $t: DateTime!) { event(userId: $u, ts: $t) { userId type value } }",
        "select user_id as \"userId\", event_type as type, value from events where (user_id, ts) in (select (user_id, ts) from events where event_id = 3)",
    ),
    "variable_default": Case("query S($s: String = \"AUTOMOBILE\") { customersBySegment(segment: $s) { custKey segment } }", "select c_custkey as \"custKey\", c_mktsegment as segment from customer where c_mktsegment = 'AUTOMOBILE'"),
    "argument_default": Case("{ customersBySegment { custKey segment } }", "select c_custkey as \"custKey\", c_mktsegment as segment from customer where c_mktsegment = 'BUILDING'"),
    "fragment_spread": Case("{ orders { ...Brief } } fragment Brief on Order { orderKey status }", 'select o_orderkey as "orderKey", o_orderstatus as status from orders'),
    "inline_fragment": Case("{ orders { ... on Order { orderKey } ... { status } } }", 'select o_orderkey as "orderKey", o_orderstatus as status from orders'),
    "nested_fragments": Case(
        "{ orders { ...A } } fragment A on Order { orderKey ...B } fragment B on Order { status customer { ...C } } fragment C on Customer { name }",
        'select o_orderkey as "orderKey", o_orderstatus as status, c_name as customer__name from orders left join customer on o_custkey = c_custkey',
    ),
    "skip_include": Case(
        "query Q($yes: Boolean!) { orders { orderKey @include(if: $yes) status @skip(if: $yes) priority } }",
        'select o_orderkey as "orderKey", o_orderpriority as priority from orders',
        {"yes": True},
    ),
    "typename": Case("{ nations { __typename name region { __typename } } }", "select 'Nation' as __typename, n_name as name, 'Region' as region____typename from nation"),
    "extension_one_hop": Case(
        "{ customers { custKey name orders { orderKey totalPrice } } }",
        'select c_custkey as "custKey", c_name as name, o_orderkey as "orders__orderKey", o_totalprice as "orders__totalPrice" from customer left join orders on o_custkey = c_custkey',
    ),
    "extension_two_hop": Case(
        "{ customers { custKey orders { orderKey lineItems { quantity extendedPrice } } } }",
        'select c_custkey as "custKey", o_orderkey as "orders__orderKey", l_quantity as "orders__lineItems__quantity", l_extendedprice as "orders__lineItems__extendedPrice" from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey',
    ),
    "reference_one_hop": Case("{ orders { orderKey customer { name balance } } }", 'select o_orderkey as "orderKey", c_name as customer__name, c_acctbal as customer__balance from orders left join customer on o_custkey = c_custkey'),
    "reference_chain": Case(
        "{ orders { orderKey customer { name nation { name region { name } } } } }",
        'select o_orderkey as "orderKey", c_name as customer__name, n_name as customer__nation__name, r_name as customer__nation__region__name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey',
    ),
    "loopback": Case(
        "{ customers { custKey orders { orderKey customer { name segment } } } }",
        'select a.c_custkey as "custKey", o_orderkey as "orders__orderKey", b.c_name as orders__customer__name, b.c_mktsegment as orders__customer__segment from customer a left join orders on o_custkey = a.c_custkey left join customer b on o_custkey = b.c_custkey',
    ),
    "alternate_key": Case("{ nation(name: \"NATION_3\") { nationKey name region { name } } }", "select n_nationkey as \"nationKey\", n_name as name, r_name as region__name from nation left join region on n_regionkey = r_regionkey where n_name = 'NATION_3'"),
    "non_resolvable_stub": Case("{ customers { custKey nation { nationKey name } } }", 'select c_custkey as "custKey", c_nationkey as "nation__nationKey", n_name as nation__name from customer left join nation on c_nationkey = n_nationkey'),
    "key_only_reference": Case("{ customers { custKey nation { nationKey } } }", 'select c_custkey as "custKey", c_nationkey as "nation__nationKey" from customer'),
    "composite_key_entity": Case(
        "{ turns { convId turn role reply { turn role } } }",
        'select a.conv_id as "convId", a.turn, a.role, a.turn + 1 as reply__turn, b.role as reply__role from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1',
    ),
    "composite_key_extension": Case("{ events { userId value rank score } }", 'select user_id as "userId", value, cast(length(event_type) as int) as rank, value * 10 as score from events'),
    "sparse_extension": Case("{ documents { docId lang quality toxic } }", 'select d.doc_id as "docId", lang, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id'),
    "sparse_children": Case("{ customers { custKey events { type value } } }", 'select c_custkey as "custKey", event_type as events__type, value as events__value from customer left join events on user_id = c_custkey'),
    "field_argument": Case(
        '{ customers { custKey orders(status: "F") { orderKey status } } }',
        "select c_custkey as \"custKey\", o_orderkey as \"orders__orderKey\", o_orderstatus as orders__status from customer left join (select * from orders where o_orderstatus = 'F') on o_custkey = c_custkey",
    ),
    "requires_simple": Case("{ customers { custKey creditHeadroom } }", 'select c_custkey as "custKey", c_acctbal * 2 + 1000 as "creditHeadroom" from customer'),
    "requires_two_sources": Case(
        "{ customers { custKey riskScore } }",
        'select c_custkey as "custKey", c_acctbal / 100 - coalesce(n, 0) as "riskScore" from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey',
    ),
    "requires_chain": Case(
        "{ customers { custKey riskGrade } }",
        "select c_custkey as \"custKey\", case when c_acctbal / 100 - coalesce(n, 0) >= 50 then 'high' when c_acctbal / 100 - coalesce(n, 0) >= 0 then 'low' else 'none' end as \"riskGrade\" from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey",
    ),
    "requires_below_list": Case("{ customers { custKey orders { orderKey taxEstimate } } }", 'select c_custkey as "custKey", o_orderkey as "orders__orderKey", o_totalprice * 0.25 as "orders__taxEstimate" from customer left join orders on o_custkey = c_custkey'),
    "provides_join_elim": Case("{ snapshots { orderKey customer { custKey name } } }", 'select o_orderkey as "orderKey", o_custkey as "customer__custKey", c_name as customer__name from orders join customer on o_custkey = c_custkey'),
    "shareable_prefer_joined": Case("{ orders { orderKey totalPrice } }", 'select o_orderkey as "orderKey", o_totalprice as "totalPrice" from orders'),
    "override_field": Case("{ parts { partKey name retailPrice } }", 'select p_partkey as "partKey", p_name as name, p_retailprice * 0.5 as "retailPrice" from part'),
    "external_not_owned": Case("{ orders { orderKey customer { custKey balance } } }", 'select o_orderkey as "orderKey", o_custkey as "customer__custKey", c_acctbal as customer__balance from orders left join customer on o_custkey = c_custkey'),
    "union_search": Case(
        '{ search(text: "1") { __typename ... on Part { partKey name } ... on Supplier { suppKey balance } } }',
        """select 'Part' as __typename, p_partkey as "partKey", p_name as name, null::bigint as "suppKey", null::double as balance from part where contains(p_name, '1')
union all select 'Supplier', null, null, s_suppkey, s_acctbal from supplier where contains(s_name, '1')""",
    ),
    "interface_node": Case(
        "{ nodes { __typename name ... on Part { brand } ... on Supplier { nation { name } } } }",
        """select 'Part' as __typename, p_name as name, p_brand as brand, null::varchar as nation__name from part
union all select 'Supplier', s_name, null, n_name from supplier left join nation on s_nationkey = n_nationkey""",
    ),
    "batch_dedup": Case("{ lineItems { lineNumber quantity part { partKey name } } }", 'select l_linenumber as "lineNumber", l_quantity as quantity, l_partkey as "part__partKey", p_name as part__name from lineitem left join part on l_partkey = p_partkey'),
    "two_references": Case(
        "{ lineItems { quantity part { brand } supplier { name nation { name } } } }",
        "select l_quantity as quantity, p_brand as part__brand, s_name as supplier__name, n_name as supplier__nation__name from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey",
    ),
    "list_fanout": Case(
        "{ baskets { custKey orders { pos order { orderKey status } } } }",
        'select o_custkey as "custKey", cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as orders__pos, o_orderkey as "orders__order__orderKey", o_orderstatus as orders__order__status from orders',
    ),
    "prune_hidden_keys": Case("{ orders { customer { nation { name } } } }", "select n_name as customer__nation__name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey"),
    "aliases": Case("{ all: orders { key: orderKey buyer: customer { who: name } } }", "select o_orderkey as key, c_name as buyer__who from orders left join customer on o_custkey = c_custkey"),
    "second_extension": Case("{ nations { name suppliers { suppKey } } }", 'select n_name as name, s_suppkey as "suppliers__suppKey" from nation left join supplier on s_nationkey = n_nationkey'),
    "partial_entity_failure": Case("{ documents { docId lang quality } }", "select null::bigint as \"docId\", lang, null::int as quality from documents", down=("labels",)),
    "partial_root_failure": Case("{ orders { orderKey status } }", "select null::varchar as \"orderKey\", null::varchar as status where false", down=("sales",)),
    "partial_key_nulling": Case("{ customers { custKey name orders { orderKey } } }", "select null::bigint as \"custKey\", c_name as name, null::varchar as \"orders__orderKey\" from customer", down=("sales",)),
    "partial_reference_failure": Case("{ customers { custKey nation { nationKey name } } }", "select c_custkey as \"custKey\", null::varchar as \"nation__nationKey\", null::varchar as nation__name from customer", down=("geo",)),
    "partial_isolated": Case("{ documents { docId lang quality } }", "select null::bigint as \"docId\", lang, null::int as quality from documents", down=("labels",), mode="isolated"),
    "partial_keys_kept": Case("{ documents { docId lang quality } }", "select doc_id as \"docId\", lang, null::int as quality from documents", down=("labels",), key_nulling=False),
    "flagship": Case(
        FLAGSHIP,
        'select c_name as name, n_name as nation__name, r_name as nation__region__name, o_orderkey as "orders__orderKey", o_totalprice as "orders__totalPrice", o_totalprice * 0.25 as "orders__taxEstimate", l_quantity as "orders__lineItems__quantity", p_name as "orders__lineItems__part__name" from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey left join part on l_partkey = p_partkey',
    ),
}


def _variables_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id = 3").select("user_id", F.col("ts").cast("string").alias("ts")).first()
    found = testgraph.build(spark, sf_dir).execute(CASES["variables_composite"].query, {"u": row["user_id"], "t": row["ts"]})
    return found["event"]


def _multi_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots of one source and one of another, put side by side."""
    found = testgraph.build(spark, sf_dir).execute("{ regions { regionKey name } nations { nationKey name } suppliers { suppKey name } }")
    parts = [found[k].toDF("key", "name").select(F.lit(k).alias("root"), F.col("key").cast("bigint").alias("key"), "name") for k in ("regions", "nations", "suppliers")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _alias_two_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = testgraph.build(spark, sf_dir).execute("{ a: customer(custKey: 1) { name } b: customer(custKey: 2) { name } }")
    return found["a"].withColumn("root", F.lit("a")).unionByName(found["b"].withColumn("root", F.lit("b")))


def _error_rows(query: str, down: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        errors = testgraph.build(spark, sf_dir, down).execute(query).errors
        return errors.select("message", F.array_join("path", ".").alias("path"), F.coalesce(F.col("extensions")["code"], F.col("extensions")["serviceName"]).alias("tag"))

    return run


def _ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r for r in testgraph.build(spark, sf_dir).graph.ownership() if r[0] in ("Part", "Document")]
    return spark.createDataFrame(rows, "type string, field string, owner string, rank int")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(testgraph.build(spark, sf_dir).graph.metadata(), "type string, field string, source string, tag string")


def _nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = testgraph.build(spark, sf_dir).execute("{ customers { custKey orders { orderKey lineItems { quantity } } } }", shape="nested")["customers"]
    lines = F.aggregate("orders", F.lit(0), lambda n, o: n + F.size(o["lineItems"]))
    return found.select("custKey", F.size("orders").cast("bigint").alias("n_orders"), lines.cast("bigint").alias("n_lines"))


def _nested_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested and, to compare, exploded again: lists, their order, and objects in objects."""
    found = testgraph.build(spark, sf_dir).execute("{ customers { custKey nation { name } orders { orderKey status lineItems { quantity part { name } } } } }", shape="nested")["customers"]
    orders = found.select("custKey", F.col("nation.name").alias("nation"), F.posexplode_outer("orders").alias("pos", "o"))
    lines = orders.select("custKey", "nation", "pos", F.col("o.orderKey").alias("orderKey"), F.col("o.status").alias("status"), F.explode_outer("o.lineItems").alias("l"))
    return lines.select("custKey", "nation", "pos", "orderKey", "status", F.col("l.quantity").alias("quantity"), F.col("l.part.name").alias("part"))


def _empty_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list without members is empty; one whose source failed is null."""
    up, down = (testgraph.build(spark, sf_dir, d).execute("{ orders { orderKey lineItems { quantity } } }", shape="nested")["orders"] for d in ((), ("fulfil",)))
    parts = [(name, f.select(F.col("lineItems").isNull().alias("is_null"), F.size("lineItems").alias("n"))) for name, f in (("up", up), ("down", down))]
    rows = [f.select(F.lit(name).alias("state"), "is_null", F.when(~F.col("is_null"), F.col("n") == 0).alias("is_empty")) for name, f in parts]
    return rows[0].unionAll(rows[1]).groupBy("state", "is_null", "is_empty").agg(F.count("*").alias("orders"))


def _json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = testgraph.build(spark, sf_dir).execute("{ regions { name nations { nationKey name } } }", shape="nested")["regions"]
    return found.select(F.to_json(F.struct("*")).alias("json"))


def _mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark)
    gateway = testgraph.build(spark, sf_dir, sink=f"{base}/created-{uuid.uuid4().hex}")
    found = gateway.execute('mutation { one: createCustomer(name: "Widget", balance: 100) { custKey name balance } two: createCustomer(name: "Gear", balance: 5.5) { custKey name balance } }')
    return found["one"].unionAll(found["two"])


def _schema_update(back: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gateway = testgraph.build(spark, sf_dir)
        labels = testgraph.SCHEMAS["labels"].replace("toxic: Int", "toxic: Int grade: Int")
        more = TypeBinding(lambda: spark.read.parquet(f"{sf_dir}/labels.parquet"), {"docId": "doc_id", "grade": "quality"})
        gateway.apply("labels", labels, SourceBinding({"Document": more}))
        if back:
            gateway.rollback()
        known = gateway.execute("{ documents { docId grade } }").data is not None
        query = "{ documents { docId quality grade } }" if known else "{ documents { docId quality } }"
        return gateway.execute(query)["documents"]

    return run


def _subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream, joined with the customers as they stand; read to its end into a table."""
    own = testgraph.bindings(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    own["sales"].roots["orderPlaced"] = Root(rows=lambda _: spark.readStream.schema(orders).parquet(f"{sf_dir}/orders*.parquet"))
    gateway = Gateway(spark, {n: (s, own[n]) for n, s in testgraph.SCHEMAS.items()})
    at = f"{shared_dir(spark)}/subscription-{uuid.uuid4().hex}"
    frame = subscribe(gateway, "subscription { orderPlaced { orderKey customer { name } } }")
    frame.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{at}/rows")


class _Ratings(BaseHTTPRequestHandler):
    """A small remote service: ratings of regions, with an error beside the data of one; the root field answers likewise."""

    SDL = 'extend type Region @key(fields: "regionKey") { regionKey: ID! @external rating: Int } type Score { value: Int } type Query { scores: [Score!]! }'

    def do_POST(self) -> None:
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "_entities" in asked["query"]:
            keys = [r["regionKey"] for r in asked["variables"]["representations"]]
            found = {"data": {"_entities": [{"rating": None if k == 2 else k * 10} for k in keys]}}
            found["errors"] = [{"message": "region 2 is not rated", "path": ["_entities", n, "rating"], "extensions": {"code": "UNRATED"}} for n, k in enumerate(keys) if k == 2]
        else:
            found = {"data": {"scores": [{"value": 1}]}, "errors": [{"message": "one score is hidden", "path": ["scores"]}]}
        body = json.dumps(found).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args: Any) -> None:
        pass


def _source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that a remote source sends with its data stand beside the data, with their paths in the query."""
    with ThreadingHTTPServer(("127.0.0.1", 0), _Ratings) as service:
        threading.Thread(target=service.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{service.server_address[1]}/"
        own = testgraph.bindings(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        rated = remote.entities(url, "Region", StructType().add("regionKey", "long").add("rating", "integer"))
        scores = remote.root(spark, url, "scores", StructType().add("value", "integer"))
        sources = {n: (testgraph.SCHEMAS[n], own[n]) for n in testgraph.SCHEMAS} | {"ratings": (_Ratings.SDL, SourceBinding({"Region": rated}, {"scores": scores}))}
        answer = Gateway(spark, sources).execute("{ regions { regionKey rating } points: scores { value } }", shape="nested").to_dict()
        service.shutdown()
    rows = [("rating", str(r["regionKey"]), str(r["rating"])) for r in answer["data"]["regions"]] + [("points", "", str(r["value"])) for r in answer["data"]["points"]]
    rows += [("error", ".".join(e["path"]), f"{e['message']}: {e['extensions'].get('serviceName')} {e['extensions'].get('code', '')}".strip()) for e in answer["errors"]]
    return spark.createDataFrame(rows, "kind string, place string, value string")


SPECIAL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "variables_composite": (_variables_composite, CASES["variables_composite"].sql),
    "multi_root": (_multi_root, "select 'regions' as root, r_regionkey::bigint as key, r_name as name from region union all select 'nations', n_nationkey, n_name from nation union all select 'suppliers', s_suppkey, s_name from supplier"),
    "alias_two_roots": (_alias_two_roots, "select c_name as name, case c_custkey when 1 then 'a' else 'b' end as root from customer where c_custkey in (1, 2)"),
    "ownership_catalog": (
        _ownership,
        "select * from (values ('Part', 'partKey', 'catalog', 0), ('Part', 'name', 'catalog', 0), ('Part', 'brand', 'catalog', 0), ('Part', 'type', 'catalog', 0), ('Part', 'size', 'catalog', 0), ('Part', 'retailPrice', 'promo', 0), ('Document', 'docId', 'docs', 0), ('Document', 'lang', 'docs', 0), ('Document', 'source', 'docs', 0), ('Document', 'nChars', 'docs', 0), ('Document', 'quality', 'labels', 0), ('Document', 'toxic', 'labels', 0)) t(type, field, owner, rank)",
    ),
    "tag_catalog": (_tags, "select * from (values ('Customer', 'name', 'crm', 'public'), ('Customer', 'segment', 'crm', 'public'), ('Customer', 'segment', 'crm', 'partner')) t(type, field, source, tag)"),
    "inaccessible_error": (_error_rows("{ customers { ...F } } fragment F on Customer { internalCode }"), "select 'Cannot query field \"internalCode\" on type \"Customer\"' as message, 'customers.internalCode' as path, 'INACCESSIBLE_FIELD' as tag"),
    "unknown_field_error": (_error_rows("{ orders { weight } }"), "select 'Cannot query field \"weight\" on type \"Order\"' as message, 'orders.weight' as path, 'INACCESSIBLE_FIELD' as tag"),
    "partial_error_rows": (
        _error_rows("{ customers { custKey orders { orderKey } nation { name } } }", ("sales", "geo")),
        "select 'source is not reachable' as message, path, tag from (values ('customers.custKey', 'sales'), ('customers.orders', 'sales'), ('customers.nation.name', 'geo'), ('customers.nation.nationKey', 'geo')) t(path, tag)",
    ),
    "root_error_rows": (_error_rows("{ orders { orderKey } }", ("sales",)), "select 'source is not reachable' as message, '' as path, 'sales' as tag"),
    "source_errors": (
        _source_errors,
        "select 'rating' as kind, cast(r_regionkey as varchar) as place, case r_regionkey when 2 then 'None' else cast(r_regionkey * 10 as varchar) end as value from region union all"
        " select * from (values ('points', '', '1'), ('error', 'points', 'one score is hidden: ratings'), ('error', 'regions.rating', 'region 2 is not rated: ratings UNRATED'))",
    ),
    "nested_list_count": (
        _nested_counts,
        'select c_custkey as "custKey", count(distinct o_orderkey) as n_orders, count(l_orderkey) as n_lines from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1',
    ),
    "nested_shape": (
        _nested_shape,
        'select c_custkey as "custKey", n_name as nation, pos, o_orderkey as "orderKey", o_orderstatus as status, l_quantity as quantity, p_name as part from customer left join nation on c_nationkey = n_nationkey left join (select *, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as pos from orders) on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey left join part on l_partkey = p_partkey',
    ),
    "empty_list_vs_null": (
        _empty_or_null,
        "select state, is_null, is_empty, count(*) as orders from (select 'up' as state, false as is_null, not exists (select 1 from lineitem where l_orderkey = o_orderkey) as is_empty from orders union all select 'down', true, null from orders) group by 1, 2, 3",
    ),
    "json_shape": (
        _json_shape,
        "select cast(to_json(struct_pack(name := r_name, nations := list(struct_pack(\"nationKey\" := n_nationkey, name := n_name) order by n_nationkey))) as varchar) as json from region join nation on n_regionkey = r_regionkey group by r_regionkey, r_name",
    ),
    "mutation_create": (_mutation, "select * from (values (-3098762910::bigint, 'Widget', 100::double), (-1070393919, 'Gear', 5.5)) t(\"custKey\", name, balance)"),
    "schema_update": (_schema_update(False), 'select d.doc_id as "docId", quality, quality as grade from documents d left join labels l on d.doc_id = l.doc_id'),
    "schema_rollback": (_schema_update(True), 'select d.doc_id as "docId", quality from documents d left join labels l on d.doc_id = l.doc_id'),
    "subscription_stream": (_subscription, 'select o_orderkey as "orderKey", c_name as customer__name from orders left join customer on o_custkey = c_custkey'),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**CASES, **{name: run for name, (run, _) in SPECIAL.items()}}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql for name, case in CASES.items()} | {name: sql for name, (_, sql) in SPECIAL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASES["flagship"](spark, sf_dir)
