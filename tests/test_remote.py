"""A remote service, played by a server in this process, as a source."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import types as T

from graphweave.gateway import Gateway
from graphweave.sources.binding import Nested, Ref, Root, SourceBinding, TypeBinding
from graphweave.sources.remote import entities, root

ITEMS = 'type Item @key(fields: "id") { id: ID! name: String! maker: Maker } type Maker @key(fields: "id") { id: ID! } type Query { items: [Item!]! }'
REMOTE = 'extend type Item @key(fields: "id") { id: ID! @external stock: Int offers: [Offer!]! } type Offer { price: Float note: Note } type Note { text: String } type Maker @key(fields: "id") { id: ID! city: String } type Query { makers(city: String): [Maker!]! }'
NOTE = T.StructType().add("text", "string")
ITEM = T.StructType().add("id", "string").add("stock", "integer").add("offers", T.ArrayType(T.StructType().add("price", "double").add("note", NOTE)))
MAKER = T.StructType().add("id", "string").add("city", "string")


class Service(BaseHTTPRequestHandler):
    asked: list = []
    broken = False
    short = False

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "_service" in body["query"]:
            data = {"data": {"_service": {"sdl": REMOTE}}}
        elif self.broken:
            data = {"errors": [{"message": "closed", "path": ["stock"], "extensions": {"code": "X"}}]}
        elif "_entities" in body["query"]:
            Service.asked.append(body["variables"]["representations"])
            data = {"data": {"_entities": [self.found(r) for r in body["variables"]["representations"]][self.short :]}}
        else:
            makers = [{"id": "m1", "city": "Oslo"}, {"id": "m2", "city": "Rome"}]
            data = {"data": {"makers": [m for m in makers if body["variables"].get("city") in (None, m["city"])]}}
        out = json.dumps(data).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    @staticmethod
    def found(r):
        if r["__typename"] == "Maker":
            return {"__typename": "Maker", "city": "Oslo"} if r["id"] == "m1" else None
        return {"__typename": "Item", "stock": 3, "offers": [{"price": 2, "note": {"text": "new"}}, {"price": 1.5, "note": None}]} if r["id"] == "1" else None

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    Service.asked, Service.broken = [], False
    with ThreadingHTTPServer(("127.0.0.1", 0), Service) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{running.server_address[1]}/"
        running.shutdown()


@pytest.fixture
def remote_gateway(spark, service):
    table = TypeBinding(lambda: spark.createDataFrame([("1", "one", "m1"), ("2", "two", "m2"), ("3", "three", None), ("4", "four", "m1")], "id string, name string, maker string"), {"maker": Ref({"id": "maker"})})
    remote = SourceBinding({"Item": entities(service, "Item", ITEM, batch=2), "Maker": entities(service, "Maker", MAKER)}, {"makers": root(spark, service, "makers", MAKER, {"city": "String"})})
    remote.types["Item"].fields["offers"] = Nested("offers")
    return Gateway(spark, {"items": (ITEMS, SourceBinding({"Item": table}, {"items": Root(order_by=["id"])})), "remote": (service, remote)})


def test_lookups(remote_gateway):
    answer = remote_gateway.execute("{ items { id stock offers { price note { text } } maker { id city } } }", shape="nested").to_dict()["data"]["items"]
    assert answer[0] == {"id": "1", "stock": 3, "offers": [{"price": 2.0, "note": {"text": "new"}}, {"price": 1.5, "note": None}], "maker": {"id": "m1", "city": "Oslo"}}
    assert answer[1] == {"id": "2", "stock": None, "offers": None, "maker": {"id": "m2", "city": None}} and answer[2]["maker"] is None
    assert max(map(len, Service.asked)) <= 2 and sorted(r["id"] for own in Service.asked for r in own if r["__typename"] == "Maker")[:2] == ["m1", "m2"]


def test_nested_in_flat_shape(remote_gateway):
    rows = remote_gateway.execute("{ items { id offers { price note { text } } } }")["items"].collect()
    assert sorted((r["id"], r["offers__price"], r["offers__note__text"]) for r in rows if r["id"] == "1") == [("1", 1.5, None), ("1", 2.0, "new")] and len(rows) == 5


def test_remote_root(remote_gateway):
    assert remote_gateway.execute('{ makers(city: "Rome") { id city } }', shape="nested").to_dict()["data"] == {"makers": [{"id": "m2", "city": "Rome"}]}
    assert len(remote_gateway.execute("{ makers { id } }", shape="nested").to_dict()["data"]["makers"]) == 2


def test_a_failing_lookup_leaves_the_rest(remote_gateway):
    """Fused: known once the answer is computed."""
    Service.broken = True
    response = remote_gateway.execute("{ items { id stock } }", shape="nested")
    assert response.all_errors == []
    answer = response.to_dict()
    assert answer["data"]["items"][0] == {"id": "1", "stock": None} and len(answer["data"]["items"]) == 4
    assert answer["errors"] == [{"message": "closed", "path": ["items", "stock"], "extensions": {"serviceName": "remote", "code": "X"}}]


def test_short_answers_are_errors(remote_gateway, monkeypatch):
    monkeypatch.setattr(Service, "short", True)
    answer = remote_gateway.execute("{ items { id stock } }", shape="nested").to_dict()
    assert {e["message"] for e in answer["errors"]} == {"2 objects were asked for, 1 came"} and answer["data"]["items"][0]["stock"] is None
    answer = remote_gateway.execute("{ items { id stock } }", shape="nested", mode="isolated").to_dict()
    assert answer["data"]["items"][0] == {"id": "1"} and answer["errors"]


def test_failing_service(remote_gateway):
    Service.broken = True
    answer = remote_gateway.execute("{ items { id stock } }", shape="nested", mode="isolated").to_dict()
    assert answer["data"]["items"][0] == {"id": "1"} and answer["errors"][0]["path"] == ["items", "stock"]
    assert remote_gateway.execute("{ makers { id } }", shape="nested").to_dict()["errors"][0]["message"] == "closed"
