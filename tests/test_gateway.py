import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from graphweave import config
from graphweave.__main__ import main
from graphweave.errors import ErrorRow, GraphError, SourceError
from graphweave.gateway import Gateway
from graphweave.server import server
from graphweave.sources.binding import Many, Root, SourceBinding, TypeBinding, append
from graphweave.sources.schema import load_schema
from graphweave.streaming.subscription import subscribe
from tests.domains import gateway

ITEMS = 'type Item @key(fields: "id") { id: ID! name: String! } type Query { items(first: Int): [Item!]! item(id: ID!): Item names: String }'
STOCK = 'extend type Item @key(fields: "id") { id: ID! @external stock: Int }'


def items(spark):
    table = TypeBinding(lambda: spark.createDataFrame([("1", "one"), ("2", "two"), ("3", None)], "id string, name string"))
    return SourceBinding({"Item": table}, {"item": Root({"id": "id"}), "items": Root(order_by=["id"])})


def stock(spark):
    return SourceBinding({"Item": TypeBinding(lambda: spark.createDataFrame([("1", 5), ("9", 7)], "id string, stock int"))})


@pytest.fixture
def two(spark):
    return Gateway(spark, {"items": (ITEMS, items(spark)), "stock": (STOCK, stock(spark))}, drain_timeout=0.5)


def test_order_misses_and_nulls(two):
    assert two.execute("{ items { id name stock } }", shape="nested").to_dict()["data"]["items"] == [
        {"id": "1", "name": "one", "stock": 5},
        {"id": "2", "name": "two", "stock": None},
        {"id": "3", "name": None, "stock": None},
    ]


def test_empty_tables(spark):
    none = SourceBinding({"Item": TypeBinding(lambda: spark.createDataFrame([], "id string, name string"))})
    found = Gateway(spark, {"items": (ITEMS, none), "stock": (STOCK, stock(spark))}).execute("{ items { id stock } }", shape="nested")
    assert found.to_dict() == {"data": {"items": []}}


def test_update_rollback_and_broken_schema(two, spark):
    query = "{ item(id: 1) { stock place } }"
    before = two.engine
    assert two.execute(query).data is None
    with pytest.raises(GraphError):
        two.apply("stock", "type {")
    with pytest.raises(GraphError, match="no source"):
        two.apply("other", STOCK)
    with pytest.raises(GraphError, match="no earlier"):
        two.rollback()
    assert two.engine is before
    more = SourceBinding({"Item": TypeBinding(lambda: spark.createDataFrame([("1", 5, "A")], "id string, stock int, place string"))})
    two.apply("stock", STOCK.replace("stock: Int", "stock: Int place: String"), more)
    assert two.execute(query, shape="nested").to_dict()["data"] == {"item": {"stock": 5, "place": "A"}}
    two.rollback()
    assert two.engine is before and two.execute(query).data is None


def test_update_waits_for_queries_but_not_forever(two):
    two._running += 1
    began = time.monotonic()
    two.apply("stock", STOCK)
    assert 0.4 < time.monotonic() - began < 5
    released = threading.Timer(0.1, lambda: [setattr(two, "_running", 0), two._idle.acquire(), two._idle.notify_all(), two._idle.release()])
    released.start()
    began = time.monotonic()
    two.apply("stock", STOCK)
    assert time.monotonic() - began < 0.45


def test_plans_are_kept(two):
    two.execute("{ items { id } }")
    first = next(iter(two.engine._plans.values()))
    two.execute("{ items { id } }")
    assert list(two.engine._plans.values()) == [first]


def test_source_errors_come_through(spark):
    def failing():
        raise SourceError(ErrorRow("no stock today", ("stock",), {"hint": "later"}), ErrorRow("really"))

    g = Gateway(spark, {"items": (ITEMS, items(spark)), "stock": (STOCK, SourceBinding({"Item": TypeBinding(failing)}))})
    answer = g.execute("{ item(id: 1) { id stock } }", shape="nested").to_dict()
    assert answer["data"] == {"item": {"id": "1", "stock": None}}
    assert answer["errors"] == [
        {"message": "no stock today", "path": ["item", "stock"], "extensions": {"serviceName": "stock", "hint": "later"}},
        {"message": "really", "path": ["item"], "extensions": {"serviceName": "stock"}},
    ]


def test_isolated_catches_what_fails_while_it_runs(spark):
    broken = TypeBinding(lambda: spark.range(3).selectExpr("cast(id as string) as id", "cast(raise_error('broken page') as int) as stock"))
    g = Gateway(spark, {"items": (ITEMS, items(spark)), "stock": (STOCK, SourceBinding({"Item": broken}))})
    answer = g.execute("{ items { id stock } }", shape="nested", mode="isolated").to_dict()
    # below a list what failed is absent
    assert answer["data"]["items"] == [{"id": k} for k in "123"] and answer["errors"][0]["path"] == ["items", "stock"]


def test_missing_table_is_a_partial_answer(spark, tmp_path):
    gone = SourceBinding({"Item": TypeBinding(lambda: spark.read.parquet(str(tmp_path / "gone")))})
    answer = Gateway(spark, {"items": (ITEMS, items(spark)), "stock": (STOCK, gone)}).execute("{ item(id: 1) { name stock } }", shape="nested").to_dict()
    assert answer["data"] == {"item": {"name": "one", "stock": None}} and answer["errors"][0]["extensions"] == {"serviceName": "stock"}


def test_mutations_run_in_order(spark, tmp_path):
    at = str(tmp_path / "items")
    sdl = ITEMS + " type Mutation { add(name: String!): Item }"

    def made(args):
        n = spark.read.schema("id string, name string").parquet(at).count() if (tmp_path / "items").exists() else 0
        return spark.createDataFrame([(str(n + 1), args["name"])], "id string, name string")

    own = SourceBinding({"Item": TypeBinding(lambda: spark.read.parquet(at))}, {"add": append(at, made)})
    g = Gateway(spark, {"items": (sdl, own)})
    answer = g.execute('mutation { a: add(name: "x") { id name } b: add(name: "y") { id name } }', shape="nested").to_dict()
    assert answer == {"data": {"a": {"id": "1", "name": "x"}, "b": {"id": "2", "name": "y"}}}
    assert len(g.execute("{ items { id } }", shape="nested").to_dict()["data"]["items"]) == 2


def test_subscription(spark, tmp_path):
    spark.createDataFrame([("1", 3), ("9", 4)], "item string, n int").write.parquet(str(tmp_path / "sales"))
    sdl = 'type Sale { n: Int item: Item } extend type Item @key(fields: "id") { id: ID! @external } type Subscription { sold: Sale }'
    from graphweave.sources.binding import Ref

    stream = SourceBinding({"Sale": TypeBinding(lambda: None, {"item": Ref({"id": "item"})})}, {"sold": Root(rows=lambda _: spark.readStream.schema("item string, n int").parquet(str(tmp_path / "sales")))})
    g = Gateway(spark, {"items": (ITEMS, items(spark)), "sales": (sdl, stream)})
    frame = subscribe(g, "subscription { sold { n item { id name } } }")
    query = frame.writeStream.format("memory").queryName("sold_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("sold_rows").collect())) == [(3, "1", "one"), (4, "9", None)]
    with pytest.raises(GraphError):
        subscribe(g, "{ items { id } }")


def test_schema_sources(tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        return STOCK if len(calls) > 2 else ""

    assert load_schema(flaky, attempts=3) == STOCK and len(calls) == 3
    with pytest.raises(GraphError, match="empty"):
        load_schema(lambda: " ", attempts=0)
    path = tmp_path / "a.graphql"
    path.write_text(ITEMS)
    assert load_schema(path) == load_schema(str(path)) == ITEMS
    with pytest.raises(GraphError):
        load_schema("http://127.0.0.1:9/none", timeout=0.2)


def test_tracing(spark):
    g = gateway(spark, "orchard", tracing=True)
    g.execute('{ plot(code: "N") { soil } }')
    assert [s.name for s in g.tracer.spans] == ["plan", "root"] and not any(s.failed for s in g.tracer.spans)


def test_explain(two):
    text = two.explain("{ items { stock } }")
    assert "1 | extension | stock | Item | items | stock | id | 0" in text and "Physical Plan" in text


def ask(port, path, body, method="POST"):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", body if body is None or isinstance(body, bytes) else json.dumps(body).encode(), method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.status, json.loads(answer.read() or "null")
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read() or "null")


def test_http(two):
    with server(two) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        port = running.server_address[1]
        assert ask(port, "/graph", {"query": "query ($id: ID!) { item(id: $id) { name } }", "variables": {"id": "2"}}) == (200, {"data": {"item": {"name": "two"}}})
        status, answer = ask(port, "/", {"query": "{ items { x } }"})
        assert status == 200 and answer["errors"][0]["extensions"]["code"] == "INACCESSIBLE_FIELD"
        assert ask(port, "/", b"{nonsense")[0] == 400 and ask(port, "/", None, "GET")[0] == 405
        assert ask(port, "/stock/apply", {"sdl": STOCK}) == (200, {"ok": True})
        assert ask(port, "/nobody/apply", {"sdl": STOCK})[0] == 500
        running.shutdown()


def test_config_and_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("p1", "Lamp")], "product_id string, name string").write.parquet(str(tmp_path / "products.parquet"))
    spark.createDataFrame([("r1", "p1", "fine")], "review_id string, product_id string, body string").write.parquet(str(tmp_path / "reviews.parquet"))
    (tmp_path / "products.graphql").write_text('type Product @key(fields: "id") { id: ID! name: String } type Query { product(id: ID!): Product }')
    (tmp_path / "reviews.graphql").write_text('type Review { id: ID! body: String } extend type Product @key(fields: "id") { id: ID! @external reviews: [Review!]! }')
    path = str(tmp_path / "gateway.yaml")
    assert main(["version"]) == 0 and main(["init", path]) == 0 and main(["init", path]) == 1
    query = '{ product(id: "p1") { name reviews { body } } }'
    capsys.readouterr()
    assert main(["run", "--config", path, query]) == 0
    assert json.loads(capsys.readouterr().out) == {"data": {"product": {"name": "Lamp", "reviews": [{"body": "fine"}]}}}
    assert main(["explain", "--config", path, query]) == 0 and "extension | reviews" in capsys.readouterr().out
    assert main(["run", "--config", path, "{ product { id } }"]) == 1


def test_durations():
    assert config.seconds("1m30s") == 90 and config.seconds("500ms") == 0.5 and config.seconds(7) == 7
    with pytest.raises(GraphError):
        config.seconds("soon")


def test_list_arguments_and_fields(spark):
    sdl = 'type T @key(fields: "id") { id: ID! parts(kind: [String!]): [P!]! } type P { n: Int kind: String } type Query { ts(ids: [ID!]): [T!]! }'
    own = SourceBinding(
        {
            "T": TypeBinding(lambda: spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), {"parts": Many({"id": "t"}, ["n"], {"kind": "kind"})}),
            "P": TypeBinding(lambda: spark.createDataFrame([("1", 2, "a"), ("1", 1, "b"), ("1", 3, "c")], "t string, n int, kind string")),
        },
        {"ts": Root({"ids": "id"}, order_by=["id"])},
    )
    answer = Gateway(spark, {"s": (sdl, own)}).execute('{ ts(ids: ["1", "3"]) { id parts(kind: ["a", "b"]) { n } } }', shape="nested").to_dict()
    assert answer["data"]["ts"] == [{"id": "1", "parts": [{"n": 1}, {"n": 2}]}, {"id": "3", "parts": []}]
