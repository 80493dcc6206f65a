"""Byte-level BPE encoding and decoding through a sentencepiece model made from the ranks.

Every byte sequence of the vocabulary is spelled with one printable character per byte and becomes
a piece whose score is its negative rank, so that sentencepiece merges the pair of least rank
first, as the ranks ask; the normaliser is the identity. The model is serialised here, field by
field. Pre-tokens, the matches of the splitting pattern, are spelled the same way and encoded one
by one; decoding maps ids to the vocabulary's bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give equal
results; an empty table gives no rows; a null list of ids decodes to no bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import bpe, common


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece ``rank + 1`` a vocabulary entry."""
    # fixed values: the field numbers and enumerations of sentencepiece's published model format
    piece_field, trainer_field, normalizer_field = 1, 2, 3
    text_field, score_field, type_field, unknown_type = 1, 2, 3, 2
    model_type_field, vocab_size_field, bpe_type = 3, 4, 2
    unk_id_field, bos_id_field, eos_id_field, pad_id_field = 40, 41, 42, 43
    name_field, dummy_prefix_field, extra_spaces_field, escape_field = 1, 3, 4, 5

    spelled = bpe.spelling()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(text_field, b"<unk>") + _field(score_field, 0.0) + _field(type_field, unknown_type)]
    pieces += [_field(text_field, "".join(spelled[b] for b in entry).encode()) + _field(score_field, -float(rank)) for rank, entry in enumerate(by_rank)]
    trainer = b"".join(_field(k, v) for k, v in ((model_type_field, bpe_type), (vocab_size_field, len(pieces)), (unk_id_field, 0), (bos_id_field, -1), (eos_id_field, -1), (pad_id_field, -1)))
    normalizer = _field(name_field, b"identity") + b"".join(_field(k, 0) for k in (dummy_prefix_field, extra_spaces_field, escape_field))
    return b"".join(_field(piece_field, p) for p in pieces) + _field(trainer_field, trainer) + _field(normalizer_field, normalizer)


class Encoder:
    """Encodes by sentencepiece and decodes by the vocabulary's bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = bpe.read_ranks(ranks_path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack some single byte, so some texts have no ids")
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self._pattern = regex.compile(pattern)
        self._spelled = dict(enumerate(bpe.spelling()))
        entries = sorted(ranks, key=ranks.__getitem__)
        self._bytes = np.frombuffer(b"".join(entries), np.uint8)
        self._length = np.array([len(e) for e in entries], np.int64)
        self._first = np.cumsum(self._length) - self._length
        self.encode = bpe.Memo(self._of_keys) if bpe.parts_at_blanks(self._of_texts, ranks) else bpe.Memo(bpe.no_chunks, whole=self._of_texts)

    def _of_keys(self, keys: pa.Array) -> bpe.Flat:
        return self._of_texts(list(map(bpe.chunk, keys.to_pylist())))

    def _of_texts(self, texts: list[str]) -> bpe.Flat:
        split = [self._pattern.findall(t) for t in texts]
        tokens = list(dict.fromkeys(t for own in split for t in own))
        spelled = [t.encode("utf-8").decode("latin-1").translate(self._spelled) for t in tokens]
        ids = dict(zip(tokens, self._model.encode(spelled, out_type=int, num_threads=1)))
        pieces, counts = bpe.flat([[x for t in own for x in ids[t]] for own in split])
        return pieces - 1, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        length = self._length[ids]
        data = self._bytes[common.ranges(self._first[ids], length)].tobytes()
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every whole text."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.once(Encoder, ranks, pattern)
        for batch in common.joined(batches):
            ids, counts = encoder.encode(batch.column("text"))
            starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts), pa.array(ids))], names=["doc_id", "ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(common.tidied(run, keeps=True), "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the ids' bytes joined."""
    common.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.once(Encoder, ranks, pattern)
        for batch in batches:
            lists = batch.column("ids").fill_null(pa.scalar([], batch.column("ids").type))
            counts = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(encoder.decode(ids, counts), pa.binary())], names=["doc_id", "ids", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(common.tidied(run, keeps=True), "doc_id bigint, ids array<int>, bytes binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decoded(encoded(common.table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
