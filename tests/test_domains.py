"""Whole answers as JSON over the two domains: complete, refused and partial ones."""

import pytest

from tests.domains import gateway

COMPLETE = {
    "own fields and one extension": ("orchard", '{ plot(code: "N") { code soil drip } }', {"plot": {"code": "N", "soil": "loam", "drip": True}}),
    "an input of a computed field stays hidden": ("orchard", '{ plot(code: "S") { expectedTonnes } }', {"plot": {"expectedTonnes": 5.0}}),
    "an extension without a row": ("orchard", '{ plot(code: "S") { soil drip } }', {"plot": {"soil": None, "drip": None}}),
    "lists in lists over three sources": (
        "orchard",
        "{ plots { code trees { species pickings { day kilos } } } }",
        {
            "plots": [
                {"code": "N", "trees": [{"species": "quince", "pickings": [{"day": "10-02", "kilos": 12.5}, {"day": "10-09", "kilos": 3.0}]}, {"species": "medlar", "pickings": []}]},
                {"code": "S", "trees": [{"species": None, "pickings": [{"day": "10-04", "kilos": 8.0}]}]},
            ]
        },
    ),
    "back to where the list began": ("orchard", '{ plot(code: "N") { trees { row plot { hectares } } } }', {"plot": {"trees": [{"row": 1, "plot": {"hectares": 1.5}}, {"row": 2, "plot": {"hectares": 1.5}}]}}),
    "either key finds a tree": ("orchard", '{ tree(tag: "t-9") { row } treeAt(plotCode: "N", row: 2) { tag } }', {"tree": {"row": 1}, "treeAt": {"tag": "t-8"}}),
    "aliases of one root": ("orchard", '{ north: plot(code: "N") { ground: soil } south: plot(code: "S") { hectares } }', {"north": {"ground": "loam"}, "south": {"hectares": 0.25}}),
    "fragments in fragments": ("orchard", '{ tree(tag: "t-7") { ...T } } fragment T on Tree { __typename ...U } fragment U on Tree { plot { ... on Plot { __typename code } } }', {"tree": {"__typename": "Tree", "plot": {"__typename": "Plot", "code": "N"}}}),
    "nothing there": ("orchard", '{ plot(code: "W") { code trees { tag } } }', {"plot": None}),
    "a key of two fields": ("archive", '{ sheet(series: "Alps", number: 3) { title metresPerInch scans { file dpi } } }', {"sheet": {"title": "Upper valley", "metresPerInch": 1270.0, "scans": [{"file": "a3-back.tif", "dpi": 300}, {"file": "a3.tif", "dpi": 600}]}}),
    "an empty list": ("archive", '{ sheet(series: "Alps", number: 4) { scans { file } } }', {"sheet": {"scans": []}}),
    "references that are set, null and missing": (
        "archive",
        '{ sheet(series: "Alps", number: 3) { scans { lastReader { card town } } } other: sheet(series: "Coast", number: 3) { scans { lastReader { town } of { scale } } } }',
        {"sheet": {"scans": [{"lastReader": None}, {"lastReader": {"card": "k1", "town": "Brig"}}]}, "other": {"scans": [{"lastReader": None, "of": {"scale": 10000}}]}},
    ),
}


@pytest.mark.parametrize("domain, query, expected", COMPLETE.values(), ids=COMPLETE)
def test_complete(spark, domain, query, expected):
    assert gateway(spark, domain).execute(query, shape="nested").to_dict() == {"data": expected}


def test_variables(spark):
    query = "query ($s: String!, $n: Int = 3) { sheet(series: $s, number: $n) { title scale } }"
    asked = lambda **v: gateway(spark, "archive").execute(query, v, shape="nested").to_dict()["data"]["sheet"]
    assert asked(s="Coast") == {"title": None, "scale": 10000} and asked(s="Alps", n=4) == {"title": "Lake", "scale": 25000}


REFUSED = [
    ("orchard", '{ plot(code: "N") { deed } }', ["plot", "deed"]),
    ("orchard", '{ tree(tag: "t-7") { plot { ...P } } } fragment P on Plot { deed }', ["tree", "plot", "deed"]),
    ("archive", '{ sheet(series: "Alps", number: 3) { ... on Sheet { shelf } } }', ["sheet", "shelf"]),
    ("archive", '{ sheet(series: "Alps", number: 3) { colour } }', ["sheet", "colour"]),
]


@pytest.mark.parametrize("domain, query, path", REFUSED)
def test_refused(spark, domain, query, path):
    answer = gateway(spark, domain).execute(query).to_dict()
    (error,) = answer["errors"]
    assert answer["data"] is None and error["path"] == path and path[-1] in error["message"] and error["extensions"]["code"] == "INACCESSIBLE_FIELD"


PARTIAL = {
    "an extension's field": ("orchard", "harvest", '{ plot(code: "N") { soil drip } }', {"plot": {"soil": "loam", "drip": None}}, ["plot.code", "plot.drip"]),
    "an extension's list": ("orchard", "trees", '{ plot(code: "S") { hectares trees { tag } } }', {"plot": {"hectares": 0.25, "trees": None}}, ["plot.code", "plot.trees"]),
    "below a list it is absent": ("orchard", "harvest", '{ plot(code: "N") { trees { row pickings { day } } } }', {"plot": {"trees": [{"row": 1}, {"row": 2}]}}, ["plot.trees.pickings", "plot.trees.tag"]),
    "behind a reference": ("orchard", "land", '{ tree(tag: "t-8") { species plot { code soil } } }', {"tree": {"species": "medlar", "plot": {"code": None, "soil": None}}}, ["tree.plot.code", "tree.plot.soil"]),
    "both fields of a key": ("archive", "scans", '{ sheet(series: "Alps", number: 4) { series number title scans { dpi } } }', {"sheet": {"series": None, "number": None, "title": "Lake", "scans": None}}, ["sheet.number", "sheet.scans", "sheet.series"]),
    "the root": ("archive", "sheets", '{ sheet(series: "Alps", number: 4) { title } }', {"sheet": None}, [""]),
}


@pytest.mark.parametrize("mode", ["fused", "isolated"])
@pytest.mark.parametrize("domain, down, query, data, paths", PARTIAL.values(), ids=PARTIAL)
def test_partial(spark, domain, down, query, data, paths, mode):
    answer = gateway(spark, domain, [down]).execute(query, shape="nested", mode=mode).to_dict()
    assert answer["data"] == data
    assert sorted(".".join(e["path"]) for e in answer["errors"]) == paths
    assert {e["extensions"]["serviceName"] for e in answer["errors"]} == {down}


def test_keys_can_be_kept(spark):
    answer = gateway(spark, "archive", ["scans"], key_nulling=False).execute('{ sheet(series: "Coast", number: 3) { series number scans { file } } }', shape="nested").to_dict()
    assert answer["data"] == {"sheet": {"series": "Coast", "number": 3, "scans": None}} and [e["path"] for e in answer["errors"]] == [["sheet", "scans"]]
