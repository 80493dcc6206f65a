"""Random selection trees over the test graph: the flat answer equals the hand-made join."""

import random

import pytest
from pyspark.sql import functions as F

from graphweave import testgraph

# type -> (table, scalars by column, references by (column, target, its key), lists by (child's column, child, own key))
TYPES = {
    "Customer": ("customer", {"custKey": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}, {"nation": ("c_nationkey", "Nation", "n_nationkey")}, {"orders": ("o_custkey", "Order", "c_custkey")}),
    "Nation": ("nation", {"nationKey": "n_nationkey", "name": "n_name"}, {"region": ("n_regionkey", "Region", "r_regionkey")}, {"suppliers": ("s_nationkey", "Supplier", "n_nationkey")}),
    "Region": ("region", {"regionKey": "r_regionkey", "name": "r_name"}, {}, {}),
    "Order": ("orders", {"orderKey": "o_orderkey", "status": "o_orderstatus", "totalPrice": "o_totalprice"}, {"customer": ("o_custkey", "Customer", "c_custkey")}, {"lineItems": ("l_orderkey", "LineItem", "o_orderkey")}),
    "LineItem": ("lineitem", {"quantity": "l_quantity", "tax": "l_tax"}, {"part": ("l_partkey", "Part", "p_partkey"), "supplier": ("l_suppkey", "Supplier", "s_suppkey")}, {}),
    "Part": ("part", {"partKey": "p_partkey", "brand": "p_brand"}, {}, {}),
    "Supplier": ("supplier", {"suppKey": "s_suppkey", "name": "s_name"}, {"nation": ("s_nationkey", "Nation", "n_nationkey")}, {}),
}
ROOTS = {"customers": "Customer", "nations": "Nation", "orders": "Order", "suppliers": "Supplier"}


def grown(rng, kind, depth, may_fan):
    """A tree: scalars, and (field, subtree) pairs with one list at most on any path's level."""
    _, scalars, refs, lists = TYPES[kind]
    own = rng.sample(sorted(scalars), rng.randint(1, len(scalars)))
    below = []
    if depth:
        for name in sorted(refs):
            if rng.random() < 0.5:
                below.append((name, grown(rng, refs[name][1], depth - 1, False)))
        if may_fan and lists and rng.random() < 0.8:
            name = rng.choice(sorted(lists))
            below.append((name, grown(rng, lists[name][1], depth - 1, True)))
    return own, below


def text(tree):
    own, below = tree
    return "{ " + " ".join([*own, *[f"{name} {text(sub)}" for name, sub in below]]) + " }"


def by_hand(read, kind, tree, path=()):
    """The same as joins; columns by path, and every table's columns under a prefix of its own."""
    table, scalars, refs, lists = TYPES[kind]
    prefix = "_".join(("t", *path)) + "_"
    df = read(table)
    df = df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
    out = [("__".join((*path, s)), prefix + scalars[s]) for s in tree[0]]
    for name, sub in tree[1]:
        far, other = (refs if name in refs else lists)[name][0], (refs if name in refs else lists)[name][1]
        key = (refs if name in refs else lists)[name][2]
        right, more = by_hand(read, other, sub, (*path, name))
        inner = "_".join(("t", *path, name)) + "_"
        condition = F.col(prefix + far) == F.col(inner + key) if name in refs else F.col(prefix + key) == F.col(inner + far)
        df, out = df.join(right, condition, "left"), out + more
    return df, out


@pytest.mark.parametrize("seed", range(12))
def test_tree(spark, sf_dir, seed):
    rng = random.Random(seed)
    root = rng.choice(sorted(ROOTS))
    tree = grown(rng, ROOTS[root], 3, True)
    found = testgraph.build(spark, sf_dir).execute(f"{{ {root} {text(tree)} }}")[root]
    df, out = by_hand(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), ROOTS[root], tree)
    wanted = df.select(*[F.col(c).alias(name) for name, c in out])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(found.columns)
    shown = lambda f: sorted(map(str, (tuple(r) for r in f.select(*order).collect())))
    assert shown(found) == shown(wanted)
