"""Secret scans: rule patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assigned values, access keys and hexadecimal strings. Beside them every run of
``RUN`` or more key characters is scored under two first-order Markov models, one of random
strings and one of ordinary identifiers; runs whose ratio is high enough, for the whole run and
per character, become further spans of kind ``random`` unless they touch a pattern's span.
The models learn from a table of labelled samples (value, label 1 for random strings).

Defined results: a null text counts as empty and has no span; offsets are code points, ends
exclusive; spans are ordered by start, then by kind as in ``KINDS``; repeated rows give equal
results; an empty table gives no rows; without samples no ``random`` span is found.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.llm import common

# Fixed values of the contract: kinds in order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
HEX = b"0123456789abcdef"
VALUE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shortest run that the models judge, and the ratio needed in all and per character (nats).
RUN, LEAST_RATIO, LEAST_PER_CHAR = 16, 14.0, 0.75
BACK_OFF = 8.0
#: Words of letters or numbers with signs between them: what may stand for ordinary identifiers.
ORDINARY = re.compile(rb"[+/_.=-]*(?>(?:[A-Z]?[a-z]{3,}(?:[A-Z][a-z]{3,})*|[a-z]+|[A-Z]+|[0-9]+)(?:[+/_.=-]+|\Z))+")
#: Bound on the documents that ordinary and random samples are taken from.
SAMPLE_DOCS = 20_000
GENERATED = 2_000
SYMBOLS = np.full(256, len(VALUE), np.uint8)
SYMBOLS[np.frombuffer(VALUE, np.uint8)] = np.arange(len(VALUE))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def runs(data: bytes, members: bytes, least: int) -> list[tuple[int, int]]:
    """Byte ranges of the maximal runs of ``members`` that are ``least`` long."""
    table = np.zeros(256, np.int8)
    table[np.frombuffer(members, np.uint8)] = 1
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist()))


def pattern_spans(text: str, hex_runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the patterns find; ``hex_runs`` in code points, if known."""
    found = []
    low = text.lower()
    if any(x in low for x in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if hex_runs is None:
        data = text.encode("utf-8", "surrogatepass")
        hex_runs = _in_code_points(data, runs(data, HEX, LEAST_HEX))
    found += [(a, 2, b) for a, b in hex_runs]
    return sorted(found)


def _in_code_points(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not spans or data.isascii():
        return spans
    inner = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)  # continuation bytes up to here
    return [(a - int(inner[a]), b - int(inner[b - 1])) for a, b in spans]


class MarkovPair:
    """Log-probability ratio of character bigrams: random strings over ordinary identifiers."""

    def __init__(self, random_values: list[str], ordinary_values: list[str]):
        self.ratio = self._log(random_values) - self._log(ordinary_values)
        self.trained = bool(random_values and ordinary_values)

    @staticmethod
    def _log(values: list[str]) -> np.ndarray:
        """Bigrams backed off to single characters, those to all characters alike."""
        n = len(VALUE) + 1
        counts = np.zeros((n, n))
        for value in values:
            codes = SYMBOLS[np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)]
            np.add.at(counts, (np.concatenate(([n - 1], codes[:-1])), codes), 1)
        single = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * n)
        return np.log((counts + BACK_OFF * single) / (counts.sum(axis=1, keepdims=True) + BACK_OFF))

    def score(self, value: bytes) -> float:
        codes = SYMBOLS[np.frombuffer(value, np.uint8)].astype(np.int64)
        return float(self.ratio[np.concatenate(([len(VALUE)], codes[:-1])), codes].sum())

    def is_random(self, value: bytes) -> bool:
        ratio = self.score(value) if self.trained else 0.0
        return ratio >= LEAST_RATIO and ratio >= LEAST_PER_CHAR * len(value)


def find(texts: list[str], models: MarkovPair) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: those of the patterns, and runs that the models take for random."""
    out = []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        long = runs(data, VALUE, RUN)
        hexes = _in_code_points(data, [(a + x, a + y) for a, b in long for x, y in runs(data[a:b], HEX, LEAST_HEX)])
        spans = pattern_spans(text, hexes)
        taken, judged = list(spans), []
        for (a, b), (start, end) in zip(long, _in_code_points(data, long)):
            value = data[a:b].rstrip(b".")
            end -= b - a - len(value)
            if len(value) >= RUN and all(end <= s or e <= start for s, _, e in taken) and models.is_random(value):
                judged.append((start, 3, end))
        out.append([(KINDS[k], s, e) for s, k, e in sorted(spans + judged)])
    return out


def labelled_samples(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """Values with labels for ``MarkovPair``: what the patterns find and generated strings are random (1), other runs of a bounded sample of the documents ordinary (0).

    About ``rows`` documents are read, picked by a hash of the id. Each gives one value of either kind at most:
    the first that the patterns find, and the longest ordinary run of all; values are cut to 256 characters.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < int(share * 1_000_003)))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got: list[tuple[str, int]] = []
            for text_ in batch["text"]:
                spans = pattern_spans(text_)
                if spans:
                    s, kind, e = spans[0]
                    value = ASSIGN.match(text_, s)[2] if kind == 0 else text_[s:e]
                    got.append((value[:256], 1))
                data = text_.encode("utf-8", "surrogatepass")
                found = [data[a:b] for a, b in runs(data, VALUE, RUN // 2)]
                taken = [text_[s:e].encode("utf-8", "surrogatepass") for s, _, e in spans]
                free = [v for v in found if ORDINARY.fullmatch(v) and not any(x in v or v in x for x in taken)]
                if free:
                    got.append((max(free, key=len).decode("ascii")[:256], 0))
            yield pd.DataFrame(got, columns=["value", "label"])

    found = sorted((r["value"], r["label"]) for r in picked.select("text").mapInPandas(common.tidied(pick), "value string, label int").collect())
    rng = random.Random(7)
    alphabets = [VALUE.decode()[:62], VALUE.decode()[:64], VALUE.decode()[26:62], VALUE.decode()[:26] + VALUE.decode()[52:62]]
    made = ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 48))) for k in range(GENERATED)]
    return found + [(value, 1) for value in made]


def train(samples: list[tuple[str, int]]) -> MarkovPair:
    return MarkovPair([v for v, label in samples if label == 1], [v for v, label in samples if label == 0])


def scan(docs: DataFrame, models: MarkovPair, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``spans``; with ``redact``, also ``redacted``: the text with that in place of each span."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def results(texts: list[str | None]) -> list[pa.Array]:
        found = find(common.texts_of(texts), shared.value)
        own = [pa.array([[dict(zip(("kind", "start", "end"), span)) for span in x] for x in found], kind)]
        return own if redact is None else [*own, pa.array([_replaced(t, x, redact) for t, x in zip(texts, found)], pa.string())]

    return common.with_results(docs, text, keep, {"spans": SPANS} | ({} if redact is None else {"redacted": "string"}), lambda: results)


def _replaced(text: str | None, spans: list[tuple[str, int, int]], mark: str) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for _, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)))
    base = "filter(spans, x -> x.kind != 'random')"
    line = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = "cast(size(filter(spans, x -> x.kind = '{}')) as bigint) as n_{}"
    return found.selectExpr(
        "doc_id",
        *[count.format(kind, kind) for kind in KINDS[:3]],
        f"sha2({line.format(base)}, 256) as base_sha256",
        f"{line.format('spans')} as spans",
    )


