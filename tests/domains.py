"""Two small domains of our own over local rows: an orchard (plots, trees, pickings) and a map archive (sheets, scans, loans)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphweave.gateway import Gateway
from graphweave.sources.binding import Compute, Many, Ref, Root, SourceBinding, TypeBinding, Unreachable

PLOTS = """
type Plot @key(fields: "code") { code: ID! hectares: Float! @shareable soil: String @tag(name: "survey") deed: String @inaccessible }
type Query { plot(code: ID!): Plot plots: [Plot!]! }
"""
TREES = """
type Tree @key(fields: "tag") @key(fields: "plotCode row") { tag: ID! plotCode: ID! row: Int! species: String plot: Plot! }
extend type Plot @key(fields: "code") { code: ID! @external trees: [Tree!]! }
type Query { tree(tag: ID!): Tree treeAt(plotCode: ID!, row: Int!): Tree }
"""
PICKINGS = """
type Picking { day: String! kilos: Float! }
extend type Tree @key(fields: "tag") { tag: ID! @external pickings: [Picking!]! }
extend type Plot @key(fields: "code", resolvable: false) { code: ID! @external hectares: Float! @external drip: Boolean expectedTonnes: Float @requires(fields: "hectares") }
"""
SHEETS = """
type Sheet @key(fields: "series number") { series: String! number: Int! title: String scale: Int! @shareable shelf: String @inaccessible }
type Query { sheet(series: String!, number: Int!): Sheet }
"""
SCANS = """
type Scan @key(fields: "file") { file: ID! dpi: Int! of: Sheet! }
extend type Sheet @key(fields: "series number") { series: String! @external number: Int! @external scale: Int! @external scans: [Scan!]! metresPerInch: Float @requires(fields: "scale") }
"""
LOANS = """
type Reader @key(fields: "card") { card: ID! town: String }
extend type Scan @key(fields: "file") { file: ID! @external lastReader: Reader }
"""


def _rows(spark: SparkSession, schema: str, *data: tuple, **fields) -> TypeBinding:
    return TypeBinding(lambda: spark.createDataFrame(list(data), schema), fields)


def orchard(spark: SparkSession) -> dict[str, tuple[str, SourceBinding]]:
    plots = _rows(spark, "code string, hectares double, soil string, deed string", ("N", 1.5, "loam", "d-1"), ("S", 0.25, None, "d-2"))
    trees = ("tag string, plotCode string, row int, species string", ("t-7", "N", 1, "quince"), ("t-8", "N", 2, "medlar"), ("t-9", "S", 1, None))
    pickings = ("tag string, day string, kilos double", ("t-7", "10-02", 12.5), ("t-7", "10-09", 3.0), ("t-9", "10-04", 8.0))
    drip = _rows(spark, "code string, drip boolean", ("N", True), expectedTonnes=Compute(lambda x, _: x["hectares"] * 20))
    return {
        "land": (PLOTS, SourceBinding({"Plot": plots}, {"plot": Root({"code": "code"}), "plots": Root(order_by=["code"])})),
        "trees": (
            TREES,
            SourceBinding(
                {"Tree": _rows(spark, *trees, plot=Ref({"code": "plotCode"})), "Plot": _rows(spark, *trees, code="plotCode", trees=Many({"code": "plotCode"}, ["row"]))},
                {"tree": Root({"tag": "tag"}), "treeAt": Root({"plotCode": "plotCode", "row": "row"})},
            ),
        ),
        "harvest": (PICKINGS, SourceBinding({"Picking": _rows(spark, *pickings), "Tree": _rows(spark, *pickings, pickings=Many({"tag": "tag"}, ["day"])), "Plot": drip})),
    }


def archive(spark: SparkSession) -> dict[str, tuple[str, SourceBinding]]:
    sheets = _rows(spark, "series string, number int, title string, scale int, shelf string", ("Alps", 3, "Upper valley", 50000, "x9"), ("Alps", 4, "Lake", 25000, "x9"), ("Coast", 3, None, 10000, "y1"))
    scans = ("file string, dpi int, s string, n int", ("a3.tif", 600, "Alps", 3), ("a3-back.tif", 300, "Alps", 3), ("c3.tif", 600, "Coast", 3))
    return {
        "sheets": (SHEETS, SourceBinding({"Sheet": sheets}, {"sheet": Root({"series": "series", "number": "number"})})),
        "scans": (
            SCANS,
            SourceBinding(
                {
                    "Scan": _rows(spark, *scans, of=Ref({"series": "s", "number": "n"})),
                    "Sheet": _rows(spark, *scans, scans=Many({"series": "s", "number": "n"}, ["file"]), metresPerInch=Compute(lambda x, _: F.round(x["scale"] * 0.0254, 4))),
                }
            ),
        ),
        "loans": (LOANS, SourceBinding({"Reader": _rows(spark, "card string, town string", ("k1", "Brig")), "Scan": _rows(spark, "file string, card string", ("a3.tif", "k1"), ("c3.tif", None), lastReader=Ref({"card": "card"}))})),
    }


DOMAINS = {"orchard": orchard, "archive": archive}


def gateway(spark: SparkSession, name: str, down=(), **options) -> Gateway:
    return Gateway(spark, {n: (sdl, Unreachable(b) if n in down else b) for n, (sdl, b) in DOMAINS[name](spark).items()}, **options)
