"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A fingerprint is a wide vector summed over the paragraphs (lines) of a text, so paragraphs can be
added or taken away, in any order, without the rest of the text:

* ``LANES`` lanes modulo 2**32, cut from the 512-bit SHA-2 of each whole paragraph: equal multisets
  of paragraphs give equal lanes, others don't but by chance;
* the number of clauses (runs of letters, digits and blanks within a paragraph) modulo 2**32, and
  ``SIGNS`` counters modulo 2**21 of how many clauses have a hash with a given bit set. Read as
  sums of random signs they estimate the cosine of two multisets of clauses: the likeness.

``combine`` adds or subtracts vectors. Counters of texts with 2**21 clauses or more wrap
like the others. Order within the text counts for ``fingerprint_text``, which appends half of the
256-bit SHA-2 of the whole text, so that equal fingerprints there mean equal texts.

Defined results: a null text counts as empty, an empty text has one empty paragraph and no clause;
an empty fingerprint is like another empty one (1) and unlike all others (0); documents follow
each other by id, null ids first, rows of one id by a hash of their text, equal rows in any order; an
only row is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweave.llm import common

LANES, SIGNS, FIELDS, FIELD_BITS = 16, 63, 3, 21
#: Equal rows are made from one of them, so many in a task.
COPIES = 1024
CLAUSE_ENDS = r"[^\p{L}\p{N} ]+"


def with_vector(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column ``name``, array<bigint>: the lanes, the number of clauses, then the counters in fields of ``FIELD_BITS`` bits, ``FIELDS`` to a number.

    Hashes are columns of their own for a while, so that each is computed once.
    """
    words, field = (1 << 32) - 1, (1 << FIELD_BITS) - 1
    clauses = F.filter(F.transform(F.split(text, CLAUSE_ENDS), lambda c: F.trim(c)), lambda c: c != "")
    hashed = rows.select("*", F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 512)).alias("own_paragraphs"), F.transform(clauses, lambda c: F.xxhash64(c, F.lit(-1))).alias("own_signs"))

    def summed(array: str, value: Callable[[Column], Column], modulus: int | None = None) -> Column:
        wrap = (lambda x: x) if modulus is None else (lambda x: x.bitwiseAND(F.lit(modulus)))
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda total, h: wrap(total + value(h)))

    def bits(k: int, mask: int) -> Callable[[Column], Column]:
        return lambda h: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask))

    def lane(k: int) -> Callable[[Column], Column]:
        """Eight of a hash's hexadecimal digits."""
        return lambda h: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint")

    lanes = [summed("own_paragraphs", lane(k), words) for k in range(LANES)]
    one = sum(1 << (FIELD_BITS * k) for k in range(FIELDS))
    many = F.size("own_signs") >= (1 << FIELD_BITS)
    counters = []
    for j in range(SIGNS // FIELDS):
        packed = summed("own_signs", bits(j, one))
        # where the fields could run over, each is summed for itself
        fields = [summed("own_signs", bits(j + FIELD_BITS * f, 1), field) for f in range(FIELDS)]
        counters.append(F.when(many, fields[0] + F.shiftleft(fields[1], FIELD_BITS) + F.shiftleft(fields[2], 2 * FIELD_BITS)).otherwise(packed))
    return hashed.select(*[F.col(c) for c in rows.columns], F.array(*lanes, F.size("own_signs").cast("bigint"), *counters).alias(name))


def combine(one: Column, other: Column, sign: int = 1) -> Column:
    """Adds (or, with ``sign`` -1, subtracts) vectors place by place, each modulo its power."""
    words, field = (1 << 32) - 1, (1 << FIELD_BITS) - 1

    def add(a: Column, b: Column, modulus: int) -> Column:
        return (a + b * F.lit(sign)).bitwiseAND(F.lit(modulus))

    out = []
    for k in range(LANES + 1 + SIGNS // FIELDS):
        a, b = one[k], other[k]
        if k <= LANES:
            out.append(add(a, b, words))
        else:
            parts = [add(F.shiftrightunsigned(a, FIELD_BITS * f).bitwiseAND(F.lit(field)), F.shiftrightunsigned(b, FIELD_BITS * f).bitwiseAND(F.lit(field)), field) for f in range(FIELDS)]
            out.append(parts[0] + F.shiftleft(parts[1], FIELD_BITS) + F.shiftleft(parts[2], 2 * FIELD_BITS))
    return F.array(*out)


def signed(v: Column) -> Column:
    """The sums of signs: twice each counter less the number of clauses."""
    field = (1 << FIELD_BITS) - 1
    counters = F.flatten(F.transform(F.slice(v, LANES + 2, SIGNS // FIELDS), lambda x: F.array(*[F.shiftrightunsigned(x, FIELD_BITS * f).bitwiseAND(F.lit(field)) for f in range(FIELDS)])))
    return F.transform(counters, lambda c: (c * 2 - v[LANES]).cast("double"))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated cosine of two multisets of clauses, 0 to 1, from their sums of signs; 1 where ``equal``."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))
    return F.when(equal, F.lit(1.0)).otherwise(cosine)


def as_text(v: Column) -> Column:
    """The vector in hexadecimal digits, lanes and count of 8 digits, counters of 16."""
    head = F.array_join(F.transform(F.slice(v, 1, LANES + 1), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(head, F.array_join(F.transform(F.slice(v, LANES + 2, SIGNS // FIELDS), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def fingerprint_text(v: Column, text: Column) -> Column:
    return F.concat(as_text(v), F.lit(":"), F.substring(F.sha2(text, 256), 1, 32))


ROW = ["named", "key", "hash"]


def _succession(classes: DataFrame) -> DataFrame:
    """``classes`` with the columns ``ROW`` of the next class as ``next_…``, of the first one after the last.

    Ranges of the order, bounded by Spark's sample, are one partition each; the first class of each
    range follows the last one of the range before. There are as many ranges as shuffle partitions.
    """
    ranges = common.materialize(classes.repartitionByRange(*ROW).withColumn("part", F.spark_partition_id()), "classes")
    within = Window.partitionBy("part").orderBy(*ROW)
    firsts = ranges.groupBy("part").agg(F.min(F.struct(*ROW)).alias("first"))
    order = Window.orderBy("part")  # a row for each range
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    led = ranges.select("*", F.lead(F.struct(*ROW)).over(within).alias("next")).join(after, "part")
    return led.select(*classes.columns, *[F.coalesce(f"next.{c}", f"after.{c}").alias(f"next_{c}") for c in ROW])


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``vector``, ``next_vector`` and ``next_head``: the first half as many characters as the text's own of the next text by ascending id, of the first after the last.

    Order is found from ids and hashes alone. Then each text meets what it needs of the next one by
    a join on them, so no id holds a task up. Rows with one id and one text are a class: it is made
    up once and stands for the last of its rows, and the others are followed by their like.
    """
    rows = docs.withColumn("named", F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("doc_id", F.lit(0))).withColumn("hash", F.xxhash64("text"))
    classes = common.materialize(rows.groupBy(*ROW).agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("size")), "ids")
    repeated = common.materialize(classes.where("copies > 1").select(*ROW, "copies"), "repeated")
    twins = rows.join(repeated, ROW).groupBy(*ROW).agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    base = rows.join(repeated, ROW, "left_anti").select(*ROW, "text").unionAll(twins.select(*ROW, "text"))
    dealt = with_vector(base, "text", "vector").repartition(*ROW)
    links = _succession(classes.select(*ROW, "size"))
    heads = dealt.join(links.select(*[F.col(c).alias(f"own_{c}") for c in ROW], "size", *[F.col(f"next_{c}").alias(c) for c in ROW]), ROW)
    heads = heads.select(*[F.col(f"own_{c}").alias(c) for c in ROW], F.substring("text", F.lit(1), F.floor(F.col("size") / 2).cast("int")).alias("next_head"), F.col("vector").alias("next_vector"))
    doc_id = F.when(F.col("named"), F.col("key")).alias("doc_id")
    last = dealt.join(heads, ROW).select(doc_id, "text", "vector", "next_vector", "next_head")
    chunks = twins.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 2) div {COPIES})"))).repartition(*ROW, "chunk")
    others = with_vector(chunks, "text", "vector").withColumn("copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - 1 - chunk * {COPIES}))")))
    half = F.floor(F.length("text") / 2).cast("int")
    return last.unionAll(others.select(doc_id, "text", "vector", F.col("vector").alias("next_vector"), F.substring("text", F.lit(1), half).alias("next_head")))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, vector, fingerprint) of every whole text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_vector(rows, "text", "vector").select("doc_id", "vector", fingerprint_text(F.col("vector"), F.col("text")).alias("fingerprint"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    kept = F.col("n_chars").cast("int") - F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "next_head"))
    rows = with_vector(rows, "edited", "edited_vector").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        *[fingerprint_text(F.col(v), F.col(t)).alias(name) for v, t, name in (("vector", "text", "fingerprint"), ("edited_vector", "edited", "edited_fingerprint"))],
        *[signed(F.col(v)).alias(f"signed_{v}") for v in ("vector", "edited_vector", "next_vector")],
        *[(F.col("vector") == F.col(v)).alias(f"equal_{v}") for v in ("edited_vector", "next_vector")],
    )
    near = lambda v: likeness(F.col("signed_vector"), F.col(f"signed_{v}"), F.col(f"equal_{v}"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_vector").alias("near_edited"), near("next_vector").alias("near_next"))
