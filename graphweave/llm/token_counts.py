"""Token counts by section: whole documents encoded once, their tokens attributed to spans.

The ids' byte lengths give every token's place in its document; sections are spans of characters
that don't overlap. Tokens and sections are joined as intervals, and a token that crosses a
boundary is allocated by rule: ``majority``, to the section that holds most of its bytes, the
earlier one on a tie; ``start``, to the section with its first byte; ``share``, to each section in
proportion to its bytes. What lies in no section is counted under the name null.

Defined results: a null or empty text has the spans that its section function gives for an empty
text (one empty line), with no tokens; repeated rows are attributed alike; an empty table gives no
rows; other columns than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import bpe, common

Spans = list[tuple[int, int]]


def lines(text: str) -> Spans:
    """The lines of a text, each with its line end."""
    found, at = [], 0
    while (end := text.find("\n", at)) >= 0:
        found.append((at, end + 1))
        at = end + 1
    if at < len(text) or not found:
        found.append((at, len(text)))
    return found


def attribute(text: str, token_bytes: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by majority, by start and by share of each span, then of what is in none.

    ``token_bytes``: each token's length; ``spans``: ascending, in code points.
    """
    n = len(spans)
    begins, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    if not text.isascii():
        first = np.flatnonzero((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)
        places = np.append(first, int(token_bytes.sum()))
        begins, ends = places[begins], places[ends]
    limits = np.concatenate(([0], np.cumsum(token_bytes)))
    cuts = np.union1d(limits, np.concatenate([begins, ends]))
    cuts = cuts[cuts <= limits[-1]]
    length, at = np.diff(cuts), cuts[:-1]
    token = np.searchsorted(limits, at, "right") - 1
    filled = np.flatnonzero(begins < ends)
    if len(filled):
        place = np.searchsorted(begins[filled], at, "right") - 1
        section = np.where((place >= 0) & (at < ends[filled][place]), filled[place], n)
    else:
        section = np.full(len(at), n)
    share = np.bincount(section, length / token_bytes[token] if len(token) else None, n + 1)
    starts = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
    started = np.bincount(section[starts], minlength=n + 1)
    parts = np.bincount(token, minlength=len(token_bytes))[token] if len(token) else token
    whole = parts == 1
    major = np.bincount(section[whole], minlength=n + 1)
    crossing = np.flatnonzero(~whole)
    if len(crossing):
        order = crossing[np.lexsort((at[crossing], -length[crossing], token[crossing]))]
        lead = np.concatenate(([True], token[order][1:] != token[order][:-1]))
        major += np.bincount(section[order[lead]], minlength=n + 1)
    return major, started, share


def token_counts(docs: DataFrame, ranks: str, pattern: str, sections: Callable[[str], Spans] = lines, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_started, token_share); ``section`` is null for what lies in none, if it has tokens."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = common.once(bpe.rank_encoder, ranks, pattern), common.once(_lengths, ranks)
        for batch in common.joined(batches):
            texts = common.texts_of(batch.column("text").to_pylist())
            doc, section, begin, end, counted = [], [], [], [], [[], [], []]
            for k, (own, ids) in enumerate(zip(texts, bpe.splits(*encoder(batch.column("text"))))):
                spans = sections(own)
                found = attribute(own, lengths[ids], spans)
                rows = len(spans) + bool(found[2][-1] > 0)
                doc.append(np.full(rows, k))
                section += [*range(len(spans)), None][:rows]
                begin += [*[s[0] for s in spans], None][:rows]
                end += [*[s[1] for s in spans], None][:rows]
                for out, x in zip(counted, found):
                    out.append(x[:rows])
            join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            columns = [batch.column("doc_id").take(join(doc, pa.int64())), pa.array(section, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), join(counted[0], pa.int64()), join(counted[1], pa.int64()), join(counted[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens", "n_started", "token_share"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(common.tidied(run, keeps=True), "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_started bigint, token_share double")


def _lengths(ranks: str) -> np.ndarray:
    entries = bpe.read_ranks(ranks)
    out = np.zeros(max(entries.values()) + 1, np.int64)
    for entry, rank in entries.items():
        out[rank] = len(entry)
    return out


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
