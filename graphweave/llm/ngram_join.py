"""N-gram Jaccard join: prefixes of token combinations, then verification.

A document is its set of distinct word shingles (tokens). Documents of one set form a class, and
classes are joined. A counter table of fixed size gives every token a frequency; tokens are put
in one global order, rarest first, and split into a rare class and frequent classes. Two sets as
similar as asked miss at most ``n - ceil(t n)`` tokens of either, so a prefix that is extended
until its rare tokens plus, for each frequent class, its tokens less one exceed that number makes
them share a rare token or a pair of tokens of one frequent class. Rare tokens and pairs are
therefore indexed. Every entry also carries how many tokens its set is sure to miss in a partner
that first meets it there; together with the sizes this bounds the overlap, and most candidates
fall without being looked at. Those that stay are compared by a bitmap of the parity of their
tokens' hashes, which differs in no more bits than the sets differ in tokens, and only then by
their sets.

Large groups need no pairs of all their members. Each entry's members are first verified against
one centre, the links' components are found, and only pairs of members that are still apart and
pass the bounds follow. That loses no link between components, so the components are exact.

Frequent classes: tokens are dealt to ``2**level / PER_CLASS`` classes by hash, where ``level`` is
the binary order of the smaller set's size, so that a prefix has a few tokens in each and emits no
more pairs than about its set's size. Sets below ``SINGLES_BELOW`` use single tokens only.

Defined results: null and empty texts and texts without words have an empty set and are linked
with nothing; repeated rows are copies of one class; ties in frequency are broken by hash; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import common
from graphweave.llm.components import components
from graphweave.llm.shingles import identity, mix, shingle_sets

COUNTER_BITS, COUNTER_BLOCK = 20, 1 << 14
LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 27
#: Rows of a key are dealt to so many tasks at most; entries with more members than HOT are split further where their members are compared.
SALTS, HOT = 256, 2048
#: A task indexes copies of a set once, as long as it remembers them.
SEEN = 200_000
#: Words of 64 bits in the parity bitmap of every set, and at least in the one that large sets have besides, which grows with them.
PARITY_WORDS, WIDE_WORDS, WIDE_FROM = 8, 128, 1000
SINGLES_BELOW, PER_CLASS = 16, 64


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


class Signatures:
    """Entries of a set in the index, for the similarity ``num / den``."""

    def __init__(self, counters: np.ndarray, num: int, den: int):
        self.counters, self.num, self.den = counters, num, den
        mean = float(counters.mean())
        self.frequent = mean + 8 * mean**0.5 + 32

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and, for each, the number of tokens that are missed before it."""
        n = len(tokens)
        smallest = _ceil(self.num * n, self.den)
        if smallest == n and n * self.den // self.num == n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)  # no other set is similar enough
        missable = n - smallest
        levels = range(smallest.bit_length() - 1, n.bit_length())  # of all sizes that the smaller set of a pair can have
        classes = {level: max(1, (1 << level) // PER_CLASS) if 1 << level >= SINGLES_BELOW else 0 for level in levels}
        longest = min(n, missable + 1 + max(classes.values()))
        counts = self.counters[tokens & np.uint64(len(self.counters) - 1)].astype(np.uint64)
        rank = (counts << np.uint64(32)) | (tokens >> np.uint64(32))
        if longest < n:
            near = rank <= np.partition(rank, longest - 1)[longest - 1]
            tokens, rank, counts = tokens[near], rank[near], counts[near]
        order = np.lexsort((tokens, rank))[:longest]
        tokens, counts = tokens[order], counts[order]
        often = counts > self.frequent
        found: dict[int, int] = {}
        for level in levels:
            for entry, miss in self._at(tokens, often, level, classes[level], missable):
                found[entry] = min(miss, found.get(entry, miss))
        return np.fromiter(found, np.uint64, len(found)), np.fromiter(found.values(), np.int32, len(found))

    def _at(self, tokens: np.ndarray, often: np.ndarray, level: int, classes: int, missable: int) -> Iterator[tuple[int, int]]:
        if not classes or not often.any():
            yield from zip(mix(tokens[: missable + 1]).tolist(), range(missable + 1))
            return
        rare = tokens[~often][: missable + 1]
        yield from zip(mix(rare).tolist(), range(len(rare)))
        short = missable + 1 - len(rare)
        members: dict[int, list[np.uint64]] = {}
        for token, cls in zip(tokens[often], ((tokens[often] >> np.uint64(20)) % np.uint64(classes)).tolist()):
            if short <= 0:
                break
            own = members.setdefault(cls, [])
            short -= bool(own)
            own.append(token)
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for own in members.values():
            if len(own) > 1:
                first, second = np.triu_indices(len(own), 1)
                own_ = np.array(own, np.uint64)
                pairs = mix(mix(own_[first] ^ salt) + own_[second])
                yield from zip(pairs.tolist(), (len(rare) + second - 1).tolist())


def parity(tokens: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """For each of ``64 * words`` buckets whether an odd number of tokens falls there."""
    buckets = (mix(tokens) % np.uint64(64 * words)).astype(np.int64)
    if words > WIDE_WORDS:  # a byte a bucket, not the eight that bincount takes
        odd = np.zeros(64 * words, np.uint8)
        np.bitwise_xor.at(odd, buckets, np.uint8(1))
    else:
        odd = (np.bincount(buckets, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_words(n: int) -> int:
    """Words of a large set's own bitmap: a power of two, two bits a token at least, so that sets of any size are told apart."""
    return max(WIDE_WORDS, 1 << max(0, (n - 1).bit_length() - 5))


def xxhash(keys: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint column."""
    # fixed values: the primes of the published 64-bit hash, and the seed that Spark takes
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    seed = np.uint64(42)
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = turned(keys.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (seed + p5 + np.uint64(8))
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


class BitFilter:
    """Flags for a set of keys, in a table that grows with their number up to ``MOST_FILTER_BITS``; keys outside the set seldom pass."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame) -> BitFilter:
        """Of one bigint column without nulls; summed by word before anything moves, and collected as one number a word."""
        bits = min(max(LEAST_FILTER_BITS, (8 * keys.count()).bit_length()), MOST_FILTER_BITS)
        place = F.xxhash64("key").bitwiseAND(F.lit((1 << bits) - 1))
        flags = keys.toDF("key").select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("flag"))
        got = flags.groupBy("word").agg(F.bit_or("flag").alias("flags")).toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[got.column("word").to_numpy()] = got.column("flags").to_numpy()
        return cls(bits, words)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        place = xxhash(keys) & ((1 << self.bits) - 1)
        return (self.words[place >> 6] >> (place & 63)) & 1 == 1


def attached(many: DataFrame, one: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """``many`` joined with the rows that ``one`` has for its ``keys``, where a key may hold most rows of ``many``.

    The rows of a key are dealt to up to ``SALTS`` tasks by a hash of ``spread``; what ``one`` has
    for the key is copied once for each that has rows, so never more often than ``many`` repeats it.
    """
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    wanted = dealt.select(*keys, "salt").distinct().join(one, keys, how)
    return dealt.join(wanted, [*keys, "salt"]).drop("salt")


def _sum_blocks(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
    return pd.DataFrame({"block": [int(group["block"].iloc[0])], "counts": [total.tobytes()]})


class JaccardJoin:
    """Joins the texts of ``docs`` with themselves at Jaccard similarity ``num / den`` of ``width``-word shingles."""

    def __init__(self, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id"):
        self.spark, self.width, self.num, self.den = docs.sparkSession, width, num, den
        common.bounded_batches(self.spark)
        # pandas would take a column of numbers with nulls for one of doubles
        self.docs = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("doc_id"), F.col(key).isNull().alias("nameless"), F.col(text).alias("text"))
        self._measure()

    def _measure(self) -> None:
        """Sets' sizes and identities of all documents, and the counter table."""
        width, words = self.width, [f"p{k}" for k in range(PARITY_WORDS)]
        longs = ["doc_id", "n", "a", "b", *words]

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counters = np.zeros(1 << COUNTER_BITS, np.int64)
            for batch in batches:
                n, one, two, bits, wide = [], [], [], [], []
                for found in shingle_sets(common.texts_of(batch["text"]), width):
                    np.add.at(counters, (found & np.uint64(len(counters) - 1)).astype(np.int64), 1)
                    a, b = identity(found)
                    n.append(len(found)), one.append(a), two.append(b), bits.append(parity(found))
                    wide.append(parity(found, wide_words(len(found))) if len(found) >= WIDE_FROM else None)
                planes = np.array(bits, np.int64).reshape(-1, PARITY_WORDS).T
                columns = [pd.arrays.IntegerArray(batch["doc_id"].to_numpy(np.int64), batch["nameless"].to_numpy(bool)), *[pd.array(x, "Int64") for x in (n, one, two, *planes)]]
                yield pd.DataFrame(dict(zip(longs, columns)) | {"wide": pd.Series(wide, dtype=object), "block": None, "counts": None})
            for k in range(0, len(counters), COUNTER_BLOCK):
                part = counters[k : k + COUNTER_BLOCK]
                if part.any():
                    yield pd.DataFrame({c: pd.array([None], "Int64") for c in longs} | {"wide": [None], "block": [k], "counts": [part.tobytes()]})

        both = common.materialize(self.docs.mapInPandas(common.tidied(measure), ", ".join(f"{c} bigint" for c in longs) + ", wide array<bigint>, block int, counts binary"), "sets", long=True)
        self.sets = both.where("block is null").select("doc_id", "n", "a", "b")
        # a class is numbered as it is written; ``rep`` is its least id, null if none of its rows has one
        classes = both.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in words])
        self.planes = common.materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.classes = self.planes.select("a", "b", "n", "rep", "cid")
        wide = [both.where("wide is not null").groupBy("a").agg(F.first("wide").alias("wide"))]
        # and as the smallest set that can be similar has it: halves of a bitmap joined by exclusive or are the bitmap of half the width
        while 1 << len(wide) - 1 < self.den / self.num:
            halves = "zip_with(slice(wide, 1, size(wide) div 2), slice(wide, size(wide) div 2 + 1, size(wide) div 2), (p, q) -> p ^ q)"
            wide.append(wide[-1].where(F.size("wide") > WIDE_WORDS).select("a", F.expr(halves).alias("wide")))
        self.wide = common.materialize(reduce(DataFrame.unionAll, wide).withColumn("words", F.size("wide")), "wide", long=True)
        self.counters = np.zeros(1 << COUNTER_BITS, np.int64)
        blocks = both.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(_sum_blocks, "block int, counts binary")
        for row in blocks.collect():  # as many counters as COUNTER_BITS says
            self.counters[row["block"] : row["block"] + COUNTER_BLOCK] = np.frombuffer(bytes(row["counts"]), np.int64)

    def entries(self) -> DataFrame:
        """(sig, node, n, miss): the index. ``node`` stands for a class, copies within a task are indexed once."""
        width, shared = self.width, self.spark.sparkContext.broadcast(Signatures(self.counters, self.num, self.den))

        def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            done: set[int] = set()
            for batch in batches:
                sigs, nodes, sizes, misses = [], [], [], []
                for found in shingle_sets(common.texts_of(batch["text"]), width):
                    node = identity(found)[0] if len(found) else 0
                    if not len(found) or node in done:
                        continue
                    if len(done) >= SEEN:
                        done.clear()
                    done.add(node)
                    sig, miss = shared.value.of(found)
                    sigs.append(sig), misses.append(miss)
                    nodes.append(np.full(len(sig), node, np.int64)), sizes.append(np.full(len(sig), len(found), np.int32))
                if sigs:
                    yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "miss": np.concatenate(misses)})

        return self.docs.select("text").mapInPandas(common.tidied(index), "sig bigint, node bigint, n int, miss int")

    @property
    def _ratio(self) -> float:
        """Sizes are dealt to blocks of this ratio (its logarithm): of a similar pair the larger set is in the smaller one's block or the next."""
        return math.log(self.den / self.num) + 1e-6

    def _cells(self, index: DataFrame, several: DataFrame) -> DataFrame:
        """The entries that may be in ``several``, by blocks of sizes: (sig, node, n, miss, place, own), where ``sig`` stands for entry and block.

        A member is in its own block's cell, and in that below for the smaller sets there. What has
        missed too much for any set of a cell stays away.
        """
        wanted, ratio, num, den = self.spark.sparkContext.broadcast(BitFilter.of(several.select("sig"))), self._ratio, self.num, self.den

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(wanted.value.passes(batch.column("sig").to_numpy())))
                sig, node, n, miss, place = (batch.column(k).to_numpy() for k in range(5))
                block = np.floor(np.log(n) / ratio)
                for own in (True, False):
                    at = block if own else block - 1
                    kept = (n - miss) * (num + den) * (1 + 1e-6) >= num * (n + np.exp(at * ratio))
                    cell = mix(sig[kept].view(np.uint64) + at[kept].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, node[kept], n[kept], miss[kept], place[kept], np.full(len(cell), own))], names=[*batch.schema.names, "own"])

        narrow = index.select("sig", "node", "n", "miss", "place")
        return narrow.mapInArrow(common.tidied(cells), "sig bigint, node bigint, n int, miss int, place bigint, own boolean")

    def _only(self, rows: DataFrame, several: DataFrame) -> DataFrame:
        """The rows whose ``sig`` may be in ``several``: few of the others pass the filter, and none of those is lost."""
        wanted = self.spark.sparkContext.broadcast(BitFilter.of(several.select("sig")))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(wanted.value.passes(batch.column("sig").to_numpy())))

        return rows.mapInArrow(common.tidied(keep), rows.schema)

    def _several(self, rows: DataFrame, centre: Column | None = None) -> DataFrame:
        """What several rows have in common, unless they are two whose bounds leave no room: ``sig``, and with ``centre`` (rows' places, or nulls) the least of these, and the number of members.

        Without ``centre`` the rows can be copies of one; with it they are different nodes.
        """
        bounds = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR((F.col("n") - F.col("miss")).cast("bigint"))
        places = [F.min(centre).alias("centre"), F.min("place").alias("first"), F.max("place").alias("last")] if centre is not None else []
        met = rows.withColumn("bounds", bounds).groupBy("sig").agg(*places, F.min("bounds").alias("low"), F.max("bounds").alias("high"), F.count("*").alias("members"))
        sizes, rest = ([F.shiftright(c, 32) for c in ("low", "high")], [F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) for c in ("low", "high")])
        may = (sizes[0] * self.den >= sizes[1] * self.num) & (F.least(*rest) * (self.num + self.den) >= (sizes[0] + sizes[1]) * self.num)
        met = met.where("first < last and centre is not null") if places else met.where("members > 1")
        return met.where((F.col("members") > 2) | may).select("sig", *["centre", "members"][: len(places)])

    def _may_link(self, x: str, y: str) -> Column:
        """Sizes and missed tokens leave room for the similarity."""
        return F.expr(
            f"least({x}.n, {y}.n) * {self.den} >= greatest({x}.n, {y}.n) * {self.num}"
            f" and cast(least({x}.n - {x}.miss, {y}.n - {y}.miss) as bigint) * {self.num + self.den} >= cast({x}.n + {y}.n as bigint) * {self.num}"
        )

    def _near(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Those of the pairs (x, y) of nodes whose parity bitmaps leave room for the similarity; and the work table that they come from."""
        sides = [self.planes.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"), F.array(*[f"p{k}" for k in range(PARITY_WORDS)]).alias(f"p_{c}")) for c in "xy"]
        differ = " + ".join(f"bit_count(p_x[{k}] ^ p_y[{k}])" for k in range(PARITY_WORDS))
        # shared tokens are at most (n_x + n_y - differ) / 2
        room = lambda d: f"(n_x + n_y - ({d})) * {self.num + self.den} >= 2 * (n_x + n_y) * {self.num}"
        known = attached(pairs.join(sides[0], "x"), sides[1], ["y"], "x")
        kept = common.materialize(known.where(room(differ)).select("x", "y", "n_x", "n_y").distinct(), "near")
        words = f"greatest({WIDE_WORDS}, shiftleft(1, greatest(0, length(bin(least(n_x, n_y) - 1)) - 5)))"
        large = kept.where(f"n_x >= {WIDE_FROM} and n_y >= {WIDE_FROM}").select("x", "y", "n_x", "n_y", F.expr(words).alias("words"))
        wide = [self.wide.select(F.col("a").alias(c), "words", F.col("wide").alias(f"wide_{c}")) for c in "xy"]
        differ = "aggregate(zip_with(wide_x, wide_y, (p, q) -> bit_count(p ^ q)), 0, (t, p) -> t + p)"
        large = attached(large.join(wide[0], ["x", "words"]), wide[1], ["y", "words"], "x").where(room(differ))
        return kept.where(f"n_x < {WIDE_FROM} or n_y < {WIDE_FROM}").select("x", "y").unionAll(large.select("x", "y")).distinct(), kept

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """(a, b, tokens) of the classes whose node is in ``nodes``, and a few others: a filter on their least ids spares the rest the work."""
        width = self.width
        reps = self.classes.join(nodes, F.col("a") == F.col("node"), "left_semi").select("rep")
        wanted = self.spark.sparkContext.broadcast(BitFilter.of(reps.where("rep is not null")))
        nameless = not reps.where("rep is null").isEmpty()  # then all rows without an id are looked at

        def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            done: set[tuple[int, int]] = set()
            for batch in batches:
                batch = batch[np.where(batch["nameless"], nameless, wanted.value.passes(batch["doc_id"].to_numpy(np.int64)))]
                rows = []
                for found in shingle_sets(common.texts_of(batch["text"]), width):
                    own = identity(found)
                    if len(found) and own not in done:
                        if len(done) >= SEEN:
                            done.clear()
                        done.add(own)
                        rows.append((*own, found.view(np.int64)))
                yield pd.DataFrame({"a": pd.array([r[0] for r in rows], "int64"), "b": pd.array([r[1] for r in rows], "int64"), "tokens": pd.Series([r[2] for r in rows], dtype=object)})

        return common.materialize(self.docs.mapInPandas(common.tidied(tokens), "a bigint, b bigint, tokens array<bigint>"), "tokens", long=True)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v: numbers of classes, u < v) among the pairs (x, y) of nodes; ``y`` may be in very many of them."""
        near = self._near(pairs)
        pairs = common.materialize(near[0], "pairs", narrow=True, long=True)
        common.discard(near[1])
        nodes = pairs.select(F.col("x").alias("node")).unionAll(pairs.select(F.col("y").alias("node"))).distinct()
        tokens = self._sets_of(nodes)
        sets = tokens.join(self.classes.select("a", "b", "cid"), ["a", "b"])
        left, right = (sets.select(F.col("a").alias(c), F.col("cid").alias(f"c_{c}"), F.col("tokens").alias(f"tokens_{c}")) for c in "xy")
        shared, both = "size(array_intersect(tokens_x, tokens_y))", "(size(tokens_x) + size(tokens_y))"
        # x's tokens move with each pair, y's once for each task that has pairs of y
        compared = attached(pairs.join(left, "x"), right, ["y"], "x")
        linked = compared.where(f"cast({shared} as bigint) * {self.num + self.den} >= cast({both} as bigint) * {self.num}")
        links = common.materialize(linked.select(F.least("c_x", "c_y").alias("u"), F.greatest("c_x", "c_y").alias("v")).where("u < v").distinct(), "links", long=True)
        common.discard(pairs, tokens)
        return links

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links (u, v) between classes, by number, that connect what is connected, and (node, component) of the linked classes."""
        # a member's place in its entry: fewest missed first, then by node; the first is the centre
        place = F.shiftleft(F.least("miss", F.lit(32767)).cast("bigint"), 48).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 48) - 1)))
        index = common.materialize(self.entries(), "index", long=True)
        several = common.materialize(self._several(index), "several")
        with common.batches_of(self.spark, 50_000):
            cells = common.materialize(self._cells(index.withColumn("place", place), several), "cells")
            common.discard(index, several)
            several = common.materialize(self._several(cells, F.when(F.col("own"), F.col("place"))), "several-cells")
            found = common.materialize(self._only(cells, several), "found", narrow=True)
            common.discard(cells)
        centres = found.join(several, (found["sig"] == several["sig"]) & (found["place"] == several["centre"]) & found["own"])
        centres = centres.select(found["sig"], F.col("node").alias("c_node"), F.col("n").alias("c_n"), F.col("miss").alias("c_miss"), "members").distinct()
        met = common.materialize(attached(found, centres, ["sig"], "node").where("node <> c_node").drop("place").distinct(), "met")
        common.discard(found, several)
        may_link = f"least(n, c_n) * {self.den} >= greatest(n, c_n) * {self.num} and cast(least(n - miss, c_n - c_miss) as bigint) * {self.num + self.den} >= cast(n + c_n as bigint) * {self.num}"
        links = self._verified(met.where(may_link).select(F.col("node").alias("x"), F.col("c_node").alias("y")).distinct())
        joined = components(links)
        rest, known = self._apart(met, joined)
        more = self._verified(rest)
        common.discard(met, known)
        if more.isEmpty():
            return links, joined
        return links.unionAll(more), components(links.unionAll(more))

    def _apart(self, met: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (x, y) of members of one entry that are in different components, as far as sizes and missed tokens leave room; and the work table that they come from.

        A member that hangs together with the cell's centre meets only those that don't. The smaller of
        a pair is in its own block's cell. Cells with more than ``HOT`` members are split: those that
        are apart go to each task, the others to one.
        """
        labels = self.classes.join(joined, F.col("cid") == F.col("node")).groupBy("a").agg(F.min("component").alias("label"))
        rows = met.where("members > 2").select("sig", "node", "n", "miss", "own", "c_node", "members")
        rows = rows.join(labels.withColumnRenamed("a", "node"), "node", "left")
        rows = attached(rows, labels.select(F.col("a").alias("c_node"), F.col("label").alias("c_label")), ["c_node"], "node", "left")
        # a class in no component stands for itself
        rows = rows.withColumn("alone", F.col("label").isNull()).withColumn("label", F.coalesce("label", "node"))
        rows = rows.withColumn("apart", F.col("alone") | F.col("c_label").isNull() | (F.col("label") != F.col("c_label")))
        table = common.materialize(rows.drop("c_node", "c_label"), "known")
        known = table.withColumn("tasks", (F.col("members") / HOT).cast("int") + 1)
        small = known.where(f"own and cast(n - miss as bigint) * {self.num + self.den} >= 2 * cast(n as bigint) * {self.num}")
        dealt = lambda rows: rows.withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int"))
        copied = lambda rows: rows.where("tasks = 1").withColumn("task", F.lit(0)).unionAll(rows.where("tasks > 1").withColumn("task", F.explode(F.expr("sequence(0, tasks - 1)"))))
        condition = F.expr("x.sig = y.sig and x.task = y.task and (x.n > y.n or x.n = y.n and x.node > y.node) and (x.alone <> y.alone or x.label <> y.label)") & self._may_link("x", "y")
        one = copied(known.where("apart")).alias("x").join(dealt(small).alias("y"), condition)
        two = dealt(known.where("not apart")).alias("x").join(copied(small.where("apart")).alias("y"), condition)
        return one.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).unionAll(two.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))).distinct(), table

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document."""
        _, joined = self.links()
        # only linked classes take part in the first two joins
        own = joined.join(self.classes.select(F.col("cid").alias("node"), "rep"), "node")
        least = own.join(own.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "least")
        named = self.classes.join(least, F.col("cid") == F.col("node"), "left").select("a", "b", "n", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least"))
        out = attached(self.sets, named, ["a", "b", "n"], "doc_id", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return JaccardJoin(docs, width=3, num=90, den=100).membership()
