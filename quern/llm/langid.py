"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (one to three letters, words padded with a blank) in order. A
document is compared to each profile by the out-of-place distance: how far each of its own most frequent n-grams lies from
its rank there, the profile's length where it is absent. The nearest profile wins, ties go to the first by name.

Profiles are fitted on a bounded sample of the labelled rows: ``fit_rows`` rows of each language as expected, chosen by a
hash of the id. Prediction reads whole texts and nothing but the text. Null texts and texts without a letter get ``und`` and
score 0. With no labelled rows every document gets ``und``. Repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, slices, tidy

BLANK = 32
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Each code point's lower-case letter, a blank for all that is no letter."""
    table = np.full(0x110000, BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers in ascending order, and how often each occurs."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = points == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # of blanks in a row the first stays
    points = np.concatenate([[BLANK], points[keep], [BLANK]]).astype(np.int64)
    if len(points) > 2 and points[1] == BLANK:
        points = points[1:]
    if len(points) > 2 and points[-2] == BLANK:
        points = points[:-1]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = points[:-1] << 21 | points[1:]
    inner = points[1:-1] != BLANK
    three = (two[:-1] << 21 | points[2:])[inner]
    return np.unique(np.concatenate([points[points != BLANK], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    if len(codes) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= cut
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Profiles of some languages, as one sorted list of n-grams and each language's rank of them."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(by_lang)
        self.codes = np.unique(np.array([c for x in by_lang.values() for c in x], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), size, np.int32)
        for k, lang in enumerate(self.langs):
            own = np.asarray(by_lang[lang], np.int64)
            self.ranks[k, np.searchsorted(self.codes, own)] = np.arange(len(own))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, and 1 less its distance as a share of the largest possible."""
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[:, at]
        out = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)))
        far = out.sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def fit_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 2000, size: int = 400) -> Profiles:
    """Profiles from labelled rows; rows whose language is null take no part.

    A profile has ``size`` n-grams, so what comes to the driver is ``size`` rows a language.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.count("*")).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                held: dict[str, list] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.setdefault(lang, []).append(grams(text))
                for lang, found in held.items():
                    codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    counts = np.bincount(place, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    total = picked.select("lang", "text").mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("lang", "rank", "gram")
    by_lang: dict[str, list[int]] = {}
    for lang, _, gram in sorted(tuple(r) for r in top.collect()):
        by_lang.setdefault(lang, []).append(gram)
    return Profiles(by_lang, size)


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each document."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [profiles.predict(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(predict), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """docs whose language is identified with a score of ``least`` or more; all their columns as they were.

    Rejected are null texts, texts without a letter, and texts that are far from every profile.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0.0 if x is None else profiles.predict(x)[1] for x in texts], dtype="float64")

    scored = F.pandas_udf(score, "double")
    return docs.filter(scored(F.col(text_col).cast("string")) >= F.lit(least))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id is of the fold that fitting must not see."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
