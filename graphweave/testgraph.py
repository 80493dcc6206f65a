"""The graph over the star-schema, event and document tables: thirteen sources and their bindings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.gateway import Gateway
from graphweave.sources.binding import Compute, Many, Ref, Root, SourceBinding, TypeBinding, Unreachable, append, exploded

LINK = 'extend schema @link(url: "https://example.org/keyed-graphs/v1", import: ["@key", "@external", "@requires", "@provides", "@shareable", "@override", "@inaccessible", "@tag"])\n'

SCHEMAS = {
    "geo": """
type Region @key(fields: "regionKey") { regionKey: ID! name: String! nations: [Nation!]! }
type Nation @key(fields: "nationKey") @key(fields: "name") { nationKey: ID! name: String! region: Region }
type Query { regions: [Region!]! nations: [Nation!]! nation(nationKey: ID, name: String): Nation }
""",
    "crm": """
type Customer @key(fields: "custKey") @key(fields: "name") {
  custKey: ID! name: String! @tag(name: "public") segment: String! @tag(name: "public") @tag(name: "partner")
  balance: Float! @shareable internalCode: String @inaccessible nation: Nation
}
type Nation @key(fields: "nationKey", resolvable: false) { nationKey: ID! }
type Query { customers: [Customer!]! customer(custKey: ID, name: String): Customer customersBySegment(segment: String = "BUILDING"): [Customer!]! }
type Mutation { createCustomer(name: String!, balance: Float!): Customer }
""",
    "sales": """
type Order @key(fields: "orderKey") { orderKey: ID! status: String! totalPrice: Float! @shareable orderDate: DateTime! priority: String! customer: Customer }
extend type Customer @key(fields: "custKey") {
  custKey: ID! @external balance: Float @external
  orders(status: String): [Order!]! orderCount: Int creditHeadroom: Float @requires(fields: "balance")
}
type Query { orders: [Order!]! order(orderKey: ID!): Order }
type Subscription { orderPlaced: Order }
scalar DateTime
""",
    "fulfil": """
type LineItem { lineNumber: Int! quantity: Float! extendedPrice: Float! discount: Float! tax: Float! part: Part supplier: Supplier }
extend type Order @key(fields: "orderKey") { orderKey: ID! @external totalPrice: Float @external lineItems: [LineItem!]! taxEstimate: Float @requires(fields: "totalPrice") }
extend type Part @key(fields: "partKey") { partKey: ID! @external }
extend type Supplier @key(fields: "suppKey") { suppKey: ID! @external }
type Query { lineItems: [LineItem!]! }
""",
    "catalog": """
interface Node { name: String! }
type Part implements Node @key(fields: "partKey") { partKey: ID! name: String! brand: String! type: String! size: Int! retailPrice: Float! }
type Query { parts: [Part!]! part(partKey: ID!): Part }
""",
    "promo": """
extend type Part @key(fields: "partKey") { partKey: ID! @external retailPrice: Float! @override(from: "catalog") }
""",
    "supply": """
type Supplier implements Node @key(fields: "suppKey") { suppKey: ID! name: String! balance: Float! nation: Nation }
extend type Nation @key(fields: "nationKey") { nationKey: ID! @external suppliers: [Supplier!]! }
type Query { suppliers: [Supplier!]! }
""",
    "activity": """
type Event @key(fields: "userId ts") { userId: ID! ts: DateTime! type: String! value: Float! }
extend type Customer @key(fields: "custKey") { custKey: ID! @external events: [Event!]! }
type Query { event(userId: ID!, ts: DateTime!): Event events: [Event!]! }
""",
    "scoring": """
extend type Event @key(fields: "userId ts") { userId: ID! @external ts: DateTime! @external value: Float @external score: Float @requires(fields: "value") rank: Int }
extend type Customer @key(fields: "custKey") {
  custKey: ID! @external balance: Float @external orderCount: Int @external
  riskScore: Float @requires(fields: "balance orderCount") riskGrade: String @requires(fields: "riskScore")
}
""",
    "docs": """
type Document @key(fields: "docId") { docId: ID! lang: String source: String nChars: Int }
type Query { documents: [Document!]! }
""",
    "labels": """
extend type Document @key(fields: "docId") { docId: ID! @external quality: Int toxic: Int }
""",
    "search": """
union SearchResult = Part | Supplier
extend type Part @key(fields: "partKey") { partKey: ID! @external }
extend type Supplier @key(fields: "suppKey") { suppKey: ID! @external }
type OrderSnapshot { orderKey: ID! customer: Customer @provides(fields: "name") }
extend type Customer @key(fields: "custKey") { custKey: ID! @external name: String @external }
type Basket { custKey: ID! orders: [BasketItem!]! }
type BasketItem { pos: Int! order: Order }
extend type Order @key(fields: "orderKey") { orderKey: ID! @external }
type Query { search(text: String!): [SearchResult!]! nodes: [Node!]! snapshots: [OrderSnapshot!]! baskets: [Basket!]! }
""",
    "chat": """
type Turn @key(fields: "convId turn") { convId: ID! turn: Int! role: String! reply: Turn }
type Query { turns: [Turn!]! }
""",
}


def bindings(table: Callable[[str], DataFrame], sink: str | None = None) -> dict[str, SourceBinding]:
    """``table`` reads a table by name; ``sink`` is where created customers go."""

    def order_counts() -> DataFrame:
        return table("orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n_orders"))

    def snapshots() -> DataFrame:
        return table("orders").join(table("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))

    def baskets() -> DataFrame:
        # lists that arrive nested, as another system might hand them over
        orders = table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
        return exploded(orders, ["o_custkey"], "keys")

    def matching(name: str, column: str) -> Callable[[dict[str, Any]], DataFrame]:
        return lambda args: table(name).where(F.contains(F.col(column), F.lit(args["text"])))

    def created(args: dict[str, Any]) -> DataFrame:
        spark = table("region").sparkSession
        key = -1 - zlib.crc32(f"{args['name']}:{float(args['balance'])}".encode())  # below all that are there
        return spark.createDataFrame([(key, args["name"], float(args["balance"]))], "c_custkey bigint, c_name string, c_acctbal double")

    customer = {"custKey": "c_custkey", "name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal", "internalCode": "c_name", "nation": Ref({"nationKey": "c_nationkey"})}
    order = {"orderKey": "o_orderkey", "status": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": "o_orderdate", "priority": "o_orderpriority", "customer": Ref({"custKey": "o_custkey"})}
    line = {
        "lineNumber": "l_linenumber",
        "quantity": "l_quantity",
        "extendedPrice": "l_extendedprice",
        "discount": "l_discount",
        "tax": "l_tax",
        "part": Ref({"partKey": "l_partkey"}),
        "supplier": Ref({"suppKey": "l_suppkey"}),
    }
    part = {"partKey": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailPrice": "p_retailprice"}
    supplier = {"suppKey": "s_suppkey", "name": "s_name", "balance": "s_acctbal", "nation": Ref({"nationKey": "s_nationkey"})}
    grade = Compute(lambda x, _: F.when(x["riskScore"] >= 50, "high").when(x["riskScore"] >= 0, "low").otherwise("none"))
    read = lambda name: lambda: table(name)
    return {
        "geo": SourceBinding(
            {
                "Region": TypeBinding(read("region"), {"regionKey": "r_regionkey", "name": "r_name", "nations": Many({"regionKey": "n_regionkey"}, ["n_nationkey"])}),
                "Nation": TypeBinding(read("nation"), {"nationKey": "n_nationkey", "name": "n_name", "region": Ref({"regionKey": "n_regionkey"})}),
            },
            {"nation": Root({"nationKey": "n_nationkey", "name": "n_name"})},
        ),
        "crm": SourceBinding(
            {"Customer": TypeBinding(read("customer"), customer)},
            {"customer": Root({"custKey": "c_custkey", "name": "c_name"}), "customersBySegment": Root({"segment": "c_mktsegment"})} | ({"createCustomer": append(sink, created)} if sink else {}),
        ),
        "sales": SourceBinding(
            {
                "Order": TypeBinding(read("orders"), order),
                "Customer": TypeBinding(
                    order_counts,
                    {
                        "custKey": "o_custkey",
                        "orderCount": "n_orders",
                        "orders": Many({"custKey": "o_custkey"}, ["o_orderkey"], {"status": "o_orderstatus"}),
                        "creditHeadroom": Compute(lambda x, _: x["balance"] * 2 + 1000),
                    },
                ),
            },
            {"order": Root({"orderKey": "o_orderkey"})},
        ),
        "fulfil": SourceBinding(
            {
                "LineItem": TypeBinding(read("lineitem"), line),
                "Order": TypeBinding(read("lineitem"), {"lineItems": Many({"orderKey": "l_orderkey"}, ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]), "taxEstimate": Compute(lambda x, _: x["totalPrice"] * 0.25)}),
            },
        ),
        "catalog": SourceBinding({"Part": TypeBinding(read("part"), part)}, {"part": Root({"partKey": "p_partkey"})}),
        "promo": SourceBinding({"Part": TypeBinding(lambda: table("part").select("p_partkey", (F.col("p_retailprice") * 0.5).alias("price")), {"partKey": "p_partkey", "retailPrice": "price"})}),
        "supply": SourceBinding({"Supplier": TypeBinding(read("supplier"), supplier), "Nation": TypeBinding(read("nation"), {"nationKey": "n_nationkey", "suppliers": Many({"nationKey": "s_nationkey"}, ["s_suppkey"])})}),
        "activity": SourceBinding(
            {
                "Event": TypeBinding(read("events"), {"userId": "user_id", "type": "event_type"}),
                "Customer": TypeBinding(read("customer"), {"custKey": "c_custkey", "events": Many({"custKey": "user_id"}, ["ts"])}),
            },
            {"event": Root({"userId": "user_id", "ts": "ts"})},
        ),
        "scoring": SourceBinding(
            {
                "Event": TypeBinding(lambda: table("events").select("user_id", "ts", F.length("event_type").alias("points")), {"userId": "user_id", "rank": "points", "score": Compute(lambda x, _: x["value"] * 10)}),
                "Customer": TypeBinding(read("customer"), {"custKey": "c_custkey", "riskScore": Compute(lambda x, _: x["balance"] / 100 - F.coalesce(x["orderCount"], F.lit(0))), "riskGrade": grade}),
            }
        ),
        "docs": SourceBinding({"Document": TypeBinding(read("documents"), {"docId": "doc_id", "nChars": "n_chars"})}),
        "labels": SourceBinding({"Document": TypeBinding(read("labels"), {"docId": "doc_id"})}),
        "search": SourceBinding(
            {
                "Part": TypeBinding(read("part"), {"partKey": "p_partkey"}),
                "Supplier": TypeBinding(read("supplier"), {"suppKey": "s_suppkey"}),
                "OrderSnapshot": TypeBinding(snapshots, {"orderKey": "o_orderkey", "customer": Ref({"custKey": "o_custkey"}, {"name": "c_name"})}),
                "Basket": TypeBinding(lambda: table("orders").select("o_custkey").distinct(), {"custKey": "o_custkey", "orders": Many({"custKey": "o_custkey"}, ["pos"])}),
                "BasketItem": TypeBinding(baskets, {"order": Ref({"orderKey": "value"})}),
            },
            {
                "search": {"Part": Root(rows=matching("part", "p_name")), "Supplier": Root(rows=matching("supplier", "s_name"))},
                "nodes": {"Part": Root(), "Supplier": Root()},
            },
        ),
        "chat": SourceBinding({"Turn": TypeBinding(lambda: table("conversations").withColumn("next_turn", F.col("turn") + 1), {"convId": "conv_id", "reply": Ref({"convId": "conv_id", "turn": "next_turn"})})}),
    }


def build(spark: SparkSession, sf_dir: str, down: Iterable[str] = (), sink: str | None = None, **options: Any) -> Gateway:
    """A gateway over the tables at ``sf_dir``; the sources ``down`` can't be reached."""
    frames: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in frames:  # each table's schema is read once
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    own = bindings(table, sink)
    own |= {name: Unreachable(own[name]) for name in down}
    return Gateway(spark, {name: (LINK + sdl, own[name]) for name, sdl in SCHEMAS.items()}, **options)


