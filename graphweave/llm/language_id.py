"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a blank; the n-grams of the whole text
are hashed into a fixed number of buckets. Counts per language are summed by partition, the
matrix of log-probabilities (buckets x languages, a size set by the parameters) is broadcast, and
whole batches of texts are scored by gathers and segment sums in numpy. A text's log-likelihood is
divided by the number of orders: each character stands in an n-gram of every order, so the plain
sum would count the text that many times over and all scores would be near 0 or 1.

Defined results: null texts and texts without a letter get ``und`` and score 0; a tie goes to the
language that sorts first; repeated rows are scored alike; an empty table gives no rows; with
nothing to learn from every text gets ``und``. Further columns of the input stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import common

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
BITS = 16
#: Bound on the training rows of each language; above it, a hash of the id picks about so many.
TRAIN_ROWS = 8_000
BLOCK = 8192
#: Texts are hashed together up to so many characters; a text that is longer goes piece by piece, so that its length costs time but little memory.
PIECE = 400_000

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    global _letters
    if _letters is None:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
        _letters = np.where(letter, points, np.uint32(32))
    return _letters


def hashed_ngrams(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of every n-gram of each order at each position, the texts' first positions, and whether each has a letter.

    An n-gram that is blank throughout or leaves its text gets bucket ``2**bits``, which weighs nothing.
    """
    joined = common.code_points("".join(f" {text.lower()} \0" for text in texts))
    ends = np.flatnonzero(joined == 0) if "\0" not in "".join(texts) else np.cumsum([len(t.lower()) + 3 for t in texts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    inside = np.ones(len(joined), bool)
    inside[ends] = False
    found, solid = _buckets(joined, inside, orders, bits)
    return found, starts, np.add.reduceat(solid.astype(np.int64), starts) > 0


def _buckets(joined: np.ndarray, inside: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket of each order's n-gram at every code point, and which code points are letters."""
    points = _letter_table()[joined]
    solid = points != 32
    found, void = [], np.uint32(1 << bits)
    code, any_solid, whole = points * np.uint32(0x9E3779B1), solid.copy(), inside.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
            any_solid = any_solid[:-1] | solid[n - 1 :]
            whole = whole[:-1] & inside[n - 1 :]
        if n in orders:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            bucket = np.full(len(points), void, np.uint32)
            bucket[: len(code)] = np.where(any_solid & whole, mixed >> np.uint32(32 - bits), void)
            found.append(bucket)
    return found, solid


def ngram_counts(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS, piece: int = PIECE) -> tuple[np.ndarray, bool]:
    """How often each bucket is hit by the n-grams of one text, all orders together, and whether it has a letter.

    The same n-grams as those of ``hashed_ngrams``: pieces overlap by what an n-gram that begins in one needs of the next.
    """
    whole, reach = f" {text.lower()} \0", max(orders) - 1
    counts, has_letter = np.zeros(2**bits + 1, np.int64), False
    for begin in range(0, len(whole), piece):
        joined = common.code_points(whole[begin : begin + piece + reach])
        inside = np.ones(len(joined), bool)
        inside[len(whole) - 1 - begin :] = False
        found, solid = _buckets(joined, inside, orders, bits)
        has_letter |= bool(solid[:piece].any())
        for bucket in found:
            counts += np.bincount(bucket[:piece], minlength=2**bits + 1)
    return counts, has_letter


def _parts(texts: list[str]) -> Iterator[tuple[list[str], bool]]:
    """Consecutive texts of about ``PIECE`` characters together, and whether it is a longer one, which comes alone."""
    begin = 0
    for k in [*[k for k, text in enumerate(texts) if len(text) > PIECE], len(texts)]:
        for first, last in common.by_size(texts[begin:k], PIECE):
            yield texts[begin + first : begin + last], False
        if k < len(texts):
            yield texts[k : k + 1], True
        begin = k + 1


@dataclass
class LanguageModel:
    """``log_prob`` has a row for each bucket, one more for what weighs nothing, and a column for each language."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        names, scores = [], []
        for part, long in _parts(texts):
            if long:
                counts, letter = ngram_counts(part[0], self.orders, self.bits)
                total, has_letter = (counts @ self.log_prob.astype(np.float64))[None], np.array([letter])
            else:
                buckets, starts, has_letter = hashed_ngrams(part, self.orders, self.bits)
                total = np.zeros((len(part), len(self.languages)))
                for bucket in buckets:
                    total += np.add.reduceat(self.log_prob[bucket], starts, axis=0, dtype=np.float64)
            total = total / len(self.orders) + self.log_prior
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.languages[k] if letter else UNDETERMINED for k, letter in zip(best, has_letter)]
            scores += np.where(has_letter, share, 0.0).tolist()
        return names, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", orders: tuple[int, ...] = ORDERS, bits: int = BITS, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learns from the rows of ``docs`` with text and language, about ``rows`` of each language at most."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    seen = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(seen)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((2**bits + 1, 0), np.float32), orders, bits)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rows / seen[name]))])
    picked = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                texts = group["text"].tolist()
                own = sums.setdefault(name, np.zeros(2**bits + 1, np.int64))
                for part, long in _parts(texts):
                    if long:
                        own += ngram_counts(part[0], orders, bits)[0]
                        continue
                    for bucket in hashed_ngrams(part, orders, bits)[0]:
                        own += np.bincount(bucket, minlength=2**bits + 1)
        for name, own in sums.items():
            for k in range(0, 2**bits, BLOCK):
                yield pd.DataFrame({"lang": [name], "block": [k], "counts": [own[: 2**bits][k : k + BLOCK].tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return group.iloc[:1].assign(counts=[total.tobytes()])

    schema = "lang string, block int, counts binary"
    counts = np.zeros((2**bits + 1, len(languages)))
    for row in picked.select("text", "lang").mapInPandas(common.tidied(count), schema).groupBy("lang", "block").applyInPandas(add, schema).collect():
        counts[row["block"] : row["block"] + min(BLOCK, 2**bits), languages.index(row["lang"])] = np.frombuffer(bytes(row["counts"]), np.int64)
    smooth = counts[:-1] + 0.5
    log_prob = np.zeros((2**bits + 1, len(languages)), np.float32)
    log_prob[:-1] = np.log(smooth / smooth.sum(axis=0))
    weight = np.array([seen[name] for name in languages], float)
    return LanguageModel(languages, np.log(weight / weight.sum()), log_prob, orders, bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text by default) with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text] if keep is None else keep

    def results(texts: list[str | None]) -> list[pa.Array]:
        names, scores = shared.value.predict(common.texts_of(texts))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return common.with_results(docs, text, kept, {"lang_pred": "string", "score": "double"}, lambda: results)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(common.learns()))
    return predict(docs.select("doc_id", common.held_out().alias("held_out"), "text"), model)
