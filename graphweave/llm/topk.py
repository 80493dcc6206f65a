"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers; the index holds, for blocks of vectors in ascending id
order, one bitmap for each bit of each component, after a shift that makes all components
non-negative. A query's score is a weighted sum of components: components with a negative weight
enter by their complement, so that all weights are positive, and the bitmaps that the weights'
bits select are added with carry-save adders, word-parallel over a block's rows. From the score's
slices the top rows are selected from the most significant slice downward; rows that still tie at
the boundary are resolved exactly, by smaller id. The blocks' best rows are merged for each query.

The index is moved once: queries, many to a row, are sent to each of its blocks (and the blocks are
copied only where they are fewer than the cluster's cores). So for a given set of queries all that
is moved grows with the rows.

Defined results: vectors that are null or hold null or non-finite components take no part; ids
that are null neither; a query never meets its own row, that is any row with its id; repeated rows
of other ids all count; ranks are by score, then id; fewer candidates than k give fewer rows. A
query meets vectors of its own width. Scaled components must leave scores within 62 bits: those of
a vector of width d are at most ``sqrt(2**62 / d)``, and vectors beyond that take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweave.llm import common

SCALE, K = 64, 20
BLOCK_ROWS, BLOCK_QUERIES = 1 << 16, 2048


class SlicedBlock:
    """Bitmaps of a block's components: ``slices[d]`` lists those of component d, least bit first."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, planes: np.ndarray):
        self.ids, self.low, self.bits, self.planes = ids, low, bits, planes
        self.present = self._bitmap(np.ones(len(ids), np.uint8))
        every = planes.reshape(-1, len(self.present))
        limits = np.concatenate(([0], np.cumsum(bits)))
        self.slices = [list(every[a:b]) for a, b in zip(limits[:-1], limits[1:])]
        self.complements = [[~x & self.present for x in own] for own in self.slices]

    @staticmethod
    def _bitmap(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0)
        shifted = (values - low).astype(np.uint64)
        bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)], np.int64)
        planes = [cls._bitmap(((shifted[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for d in range(values.shape[1]) for b in range(bits[d])]
        return cls(ids, low, bits, np.concatenate(planes) if planes else np.zeros(0, np.uint64))

    PARTS = (("ids", np.int64), ("low", np.int64), ("bits", np.int64), ("planes", np.uint64))

    def dump(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.PARTS}

    @classmethod
    def load(cls, row) -> SlicedBlock:
        return cls(*[np.frombuffer(getattr(row, name), kind) for name, kind in cls.PARTS])

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant, least bit first, and the constant."""
        columns: list[list[np.ndarray]] = []
        base = int((query * self.low).sum())
        for d in np.flatnonzero(query).tolist():
            weight = int(query[d])
            bits = self.slices[d]
            if weight < 0:
                # weight * v = -weight * (full - v) + weight * full, where full has all bits of the slices set
                base += weight * ((1 << len(bits)) - 1)
                weight, bits = -weight, self.complements[d]
            for shift in range(weight.bit_length()):
                if weight >> shift & 1:
                    for b, plane in enumerate(bits):
                        while len(columns) <= shift + b:
                            columns.append([])
                        columns[shift + b].append(plane)
        out: list[np.ndarray] = []
        at = 0
        while at < len(columns):
            planes, carries = columns[at], []
            while len(planes) > 2:
                a, b, c = planes.pop(), planes.pop(), planes.pop()
                half = a ^ b
                carries.append((a & b) | (half & c))
                planes.insert(0, half ^ c) if len(planes) > 64 else planes.append(half ^ c)
            if len(planes) == 2:
                a, b = planes
                carries.append(a & b)
                planes = [a ^ b]
            out.append(planes[0] if planes else np.zeros_like(self.present))
            if carries:
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1].extend(carries)
            at += 1
        return out, base

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to smaller ids."""
        slices, base = self.score_slices(query)
        level = self.present.copy()
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        for row in range(own.start, own.stop):
            level[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure = np.zeros_like(level)
        taken = 0  # rows in ``sure``
        for plane in reversed(slices):
            ones = level & plane
            n = int(np.bitwise_count(ones).sum())
            if taken + n > k:
                level = ones
            else:
                sure |= ones
                taken += n
                level = level & ~plane
                if taken == k:
                    break
        rows = self._rows(sure)
        if taken < k:
            rows = np.concatenate([rows, self._rows(level)[: k - taken]])
        scores = np.full(len(rows), base, np.int64)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for b, plane in enumerate(slices):
            scores += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << b
        return self.ids[rows], scores

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return words[which] * 64 + bit


def quantised(vectors: DataFrame, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, v): components times ``scale``, floored; only rows that take part."""
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0").where(finite)
    fits = f"forall(v, x -> abs(x) <= sqrt({2.0**62} / size(v)) / {scale})"
    return rows.where(fits).select("id", F.expr(f"transform(v, x -> cast(floor({scale} * x) as bigint))").alias("v"))


def _dealt(rows: DataFrame, number: int, name: str) -> DataFrame:
    """Rows with the number of their block, by a hash of the id, and their width."""
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")).withColumn("width", F.size("v"))


def _matrix(group: pd.DataFrame) -> np.ndarray:
    return np.array(group["v"].tolist(), np.int64)


def sliced_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The index: a row for each block and width, with its ids and slices."""
    schema = "block int, width int, " + ", ".join(f"{name} binary" for name, _ in SlicedBlock.PARTS)

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = SlicedBlock.of(group["id"].to_numpy(np.int64), _matrix(group)).dump()
        return pd.DataFrame({"block": [key[0]], "width": [key[1]]} | {name: [data] for name, data in parts.items()})

    return common.materialize(_dealt(rows, blocks, "block").groupBy("block", "width").applyInPandas(build, schema), "sliced-index")


def _asked(queries: DataFrame, packs: int) -> DataFrame:
    """Queries, those of a pack in one row."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pack": [key[0]], "width": [key[1]], "asked_ids": [group["id"].to_numpy(np.int64).tobytes()], "asked_data": [_matrix(group).tobytes()]})

    return _dealt(queries, packs, "pack").groupBy("pack", "width").applyInPandas(build, "pack int, width int, asked_ids binary, asked_data binary")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for each query; both inputs (id, v)."""
    spark = rows.sparkSession
    common.bounded_batches(spark)
    blocks = max(1, -(-rows.count() // block_rows))
    copies = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    packs = max(copies, -(-queries.count() // block_queries))
    index = sliced_index(rows, blocks).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asked = _asked(queries, packs).withColumn("copy", F.col("pack") % copies).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = asked.drop("pack").repartition(blocks * copies, "block", "copy").join(index.hint("shuffle_merge"), ["block", "copy", "width"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[tuple, SlicedBlock] | None = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held is None or held[0] != (row.block, row.width):
                    held = (row.block, row.width), SlicedBlock.load(row)
                query_ids = np.frombuffer(row.asked_ids, np.int64)
                queries_ = np.frombuffer(row.asked_data, np.int64).reshape(len(query_ids), -1)
                found = [(q, *held[1].best(int(q), v, k)) for q, v in zip(query_ids, queries_)]
                yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    best = met.drop("copy").mapInPandas(common.tidied(search), "query_id bigint, vec_id bigint, score bigint")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows, rows.where("id % 20 = 0"))
