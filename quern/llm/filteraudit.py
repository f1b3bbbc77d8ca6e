"""How filters interact: what each removes in each order, and its share over all orders, by the multilinear extension.

Documents are counted by part and by the set of filters that they fail (their mask); that is all that is shuffled, besides
ids and digests for the test of copies. Of these counts a part's removal polynomial is formed: the multilinear function f
of one x per filter that, where each x is 0 or 1, is the number of documents which the filters with x = 1 remove. With n(m)
documents of mask m, f = sum of n(m) * (1 - product of (1 - x_i) for i in m). A filter's Shapley value is the integral of
its partial derivative along the diagonal, taken with exact rationals; times the number of orders it is the sum of what the
filter removes over all orders. Removals, survivors and losses of a step are values of f at corners.

A null text is empty, a null part is the empty string and is one with it. Labels count once an id: 1 if any row says so;
ids without a label, and null ids, are neither good nor toxic. Rows with the same id don't make each other copies; a row with
a null id is neither a copy nor the origin of one. Repeated rows count each. An empty table gives no rows. Only the columns
named are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import words_of

COUNTED = ("n", "good", "toxic")


class RemovalPolynomial:
    """The multilinear extension of how many documents a set of filters removes. Sets are bit masks."""

    def __init__(self, counts: Sequence[int], filters: int):
        """counts[m]: documents that fail just the filters of mask m."""
        self.filters, self.total = filters, sum(counts)
        above = list(counts)  # documents that fail all of m, and maybe more
        for i in range(filters):
            for m in range(1 << filters):
                if not m >> i & 1:
                    above[m] += above[m | 1 << i]
        self.terms = {m: (1 if m.bit_count() % 2 else -1) * above[m] for m in range(1, 1 << filters) if above[m]}

    def corner(self, chosen: int) -> int:
        """Documents that the filters of this mask remove."""
        return sum(c for m, c in self.terms.items() if m & ~chosen == 0)

    def derivative(self, i: int) -> list[int]:
        """The coefficients, by power of t, of the partial derivative for filter i where all x are t."""
        out = [0] * self.filters
        for m, c in self.terms.items():
            if m >> i & 1:
                out[m.bit_count() - 1] += c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of that derivative from 0 to 1."""
        return sum((Fraction(c, power + 1) for power, c in enumerate(self.derivative(i))), Fraction(0))


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_rows(part: str, counts: dict[str, Sequence[int]], names: str) -> Iterator[tuple]:
    """A row for each order of the filters and each step of it."""
    k = len(names)
    removal, good, toxic = (RemovalPolynomial(counts[c], k) for c in COUNTED)
    corner, good_at, toxic_at = ([p.corner(m) for m in range(1 << k)] for p in (removal, good, toxic))
    shares = [removal.shapley(i) * factorial(k) for i in range(k)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over all orders must be whole")
    everything = (1 << k) - 1
    for order in permutations(range(k)):
        text, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            gone = corner[now] - corner[before]
            yield (part, text, step, removal.total - corner[now], gone, corner[1 << i] - gone, corner[everything] - corner[everything ^ 1 << i], good_at[now] - good_at[before], toxic_at[now] - toxic_at[before], int(shares[i]))
            before = now


def mask_counts(failed: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): each an array of counts by mask, of rows (part, mask, good, toxic)."""
    per_mask = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long")
    return per_mask.groupBy("part").agg(*(F.array(*(at(c, m) for m in range(1 << filters))).alias(c) for c in COUNTED))


def audit_filters(failed: DataFrame, names: str) -> DataFrame:
    """The audit of rows (part, mask, good, toxic); bit i of mask: the row fails filter names[i], of at most eight."""
    if len(names) > 8:
        raise ValueError("more than eight filters have too many orders to list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = list(zip(*audit_rows(row["part"], row, names), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in AUDIT.split(", ")])

    return mask_counts(failed, len(names)).mapInArrow(run, AUDIT)


def text_failures(text: Column) -> list[Column]:
    """Few words, few distinct words, many capitals, odd marks."""
    words = words_of(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, distinct * 100 < n * 65, capitals * 100 > F.length(text) * 5, text.rlike("[#$%&*|]")]


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document, for the four tests of its text and that of copies, in this order.

    A copy has the text of a document with a smaller id. Texts meet by digest, as one least id each, which tasks find
    before they are shuffled; then documents meet these by digest and id, so copies of one text are spread over all tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    own = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))
    origins = own.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("origin", F.lit(True))
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).filter("doc_id IS NOT NULL")
    truth = truth.groupBy("doc_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    copy = F.col("doc_id").isNotNull() & F.col("origin").isNull()
    flag = lambda c: F.when(F.col(c), 1).otherwise(0)
    joined = own.join(origins, ["digest", "doc_id"], "left").join(truth, "doc_id", "left")
    return joined.select("part", (F.col("bits") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"), flag("q").alias("good"), flag("t").alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit_filters(document_failures(docs, labels), "ABCDE")


#: For DuckDB.
AUDIT_SQL = r"""
WITH own AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
truth AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
first AS (SELECT text, min(doc_id) AS least FROM own GROUP BY text),
failed AS (
    SELECT part, coalesce(q, 0) AS good, coalesce(t, 0) AS toxic,
        [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(o.text, '[^A-Z]', '', 'g')) > 5 * length(o.text),
         regexp_matches(o.text, '[#$%&*|]'), coalesce(o.doc_id > least, false)] AS fails
    FROM own o JOIN first USING (text) LEFT JOIN truth USING (doc_id)),
profiles AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(c, i)),
orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS steps
    FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
stepped AS (SELECT filter_order, steps, s.step FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
hit AS (
    SELECT part, filter_order, step, n, good, toxic, fails, fails[steps[step]] AS here,
        len(list_filter(steps[1:step - 1], lambda x: fails[x])) > 0 AS before, len(list_filter(fails, lambda x: x)) AS failed_n
    FROM profiles, stepped),
steps AS (
    SELECT part, filter_order, step, filter_order[step] AS filter,
        sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN here AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND failed_n = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN here AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM hit GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM steps
"""
