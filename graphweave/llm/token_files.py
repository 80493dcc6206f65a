"""Token ids in ORC files: whole texts encoded, written in ascending id order, and read back.

The ids of a document are one row; the ORC writer stores them with integer run-length encoding in
stripes, with row indexes and Bloom filters on the document id, so that readers share a file by
stripes and a look-up by id reads only the row groups that can hold it. Documents are dealt by
ranges of their id, each range is one file, and each row holds its place within its file; the
files' own totals then give every document's place in the corpus.

Defined results: a null text counts as empty and gives the end id alone; null ids come first;
rows of one id stand together, ordered by a hash of their text; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweave.llm import bpe, common

END_ID = 1
STRIPE_BYTES, INDEX_STRIDE, FALSE_POSITIVES = 16 << 20, 1000, 0.01


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> None:
    """Writes (doc_id, part, before, n_tokens, ids) as ORC files to ``path``, a folder that all share."""
    common.bounded_batches(docs.sparkSession)
    dealt = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, common.once(bpe.library_encoder, tokenizer)
        for batch in common.joined(batches):
            ids, counts = encoder(batch.column("text"))
            ends = np.cumsum(counts + 1)
            whole = np.full(len(ids) + len(counts), end_id, np.int32)
            mask = np.ones(len(whole), bool)
            mask[ends - 1] = False
            whole[mask] = ids
            starts = np.concatenate(([0], ends)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + starts[:-1].astype(np.int64)), pa.array(counts + 1), pa.ListArray.from_arrays(pa.array(starts), pa.array(whole))],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )
            before += len(whole)

    rows = dealt.mapInArrow(common.tidied(encode, keeps=True), "doc_id bigint, part int, before bigint, n_tokens bigint, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.create.index": "true", "orc.row.index.stride": INDEX_STRIDE, "orc.stripe.size": STRIPE_BYTES, "orc.encoding.strategy": "COMPRESSION"}
    rows.write.options(**options).option("compression", "none").orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids) of the files at ``path``."""
    return spark.read.orc(path)


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: the filter reaches the reader, which leaves out row groups by index and Bloom filter."""
    return read_ids(spark, path).where(F.col("doc_id").isin(doc_ids))


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """``start``, which counts the ids of all documents before, in place of ``part`` and ``before``."""
    totals = rows.sparkSession.read.orc(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("before")).drop("part", "before", "base")


def with_checksum(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: of the ids as little-endian unsigned 32-bit integers."""
    others = [f for f in rows.schema.fields if f.name != "ids"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids, limits = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy().tolist()
            data = memoryview(ids).cast("B") if len(ids) else b""
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(limits, limits[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], pa.array(sums, pa.int64())], names=[*[f.name for f in others], "ids_crc32"])

    return rows.mapInArrow(common.tidied(check), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.work_path(spark, "token-ids")
    write_ids(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_start(with_checksum(read_ids(spark, path)), path).select("doc_id", "start", "n_tokens", "ids_crc32")
