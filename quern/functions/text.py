"""Column functions on text: cleaning, tokens, hashes, estimates. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Drop control characters, unify line ends, shorten runs of blank lines and blanks, unify doubled Chinese marks, strip."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.replace(F.replace(c, F.lit("，，"), F.lit("，")), F.lit("。。"), F.lit("。"))
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-case words between white space, with repetitions."""
    return F.array_remove(F.split(F.lower(c), r"(?U)\s+"), "")


def word_line(c: Column) -> Column:
    """The same words with one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def memory_terms(c: Column) -> Column:
    """Runs of two or more ASCII letters or digits, and runs of two or more Chinese characters."""
    low = F.lower(c)
    return F.array_union(F.regexp_extract_all(low, F.lit(r"([a-z0-9]{2,})"), 1), F.regexp_extract_all(low, F.lit(r"([一-鿿]{2,})"), 1))


def query_keywords(c: Column, most: int = 10) -> Column:
    """The first runs of word characters, two characters or more each."""
    return F.slice(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)([一-鿿\w]+)"), 1), lambda x: F.length(x) >= 2), 1, most)


def content_hash(c: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def query_key(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(c)), 256)


def estimate_tokens(c: Column) -> Column:
    """Half the characters, one at least; none for an empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 2))).cast("long")


def summary(c: Column, size: int = 120) -> Column:
    """One line of at most size characters."""
    line = F.translate(F.coalesce(c, F.lit("")), "\n", " ")
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size - 3), F.lit("..."))).otherwise(line)


def fingerprint_text(c: Column) -> Column:
    """The first 500 characters, and the last 300 of a text longer than that."""
    return F.when(F.length(c) > 300, F.concat(F.substring(c, 1, 500), F.lit("\n...\n"), F.substring(c, -300, 300))).otherwise(F.substring(c, 1, 500))


def image_refs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"!\[.*?\]\((.*?)\)"), 1)


def citations(c: Column) -> Column:
    return F.concat(F.regexp_extract_all(c, F.lit(r"(\[\d+\])"), 1), F.regexp_extract_all(c, F.lit(r"(（[^）]*\d{4}[^）]*）)"), 1))


def code_density(c: Column) -> Column:
    """The share of a text that lies in fenced blocks."""
    rest = F.regexp_replace(c, r"(?s)```.*?```", "")
    return F.when(F.length(c) > 0, F.least(F.lit(1.0), (F.length(c) - F.length(rest)) / F.length(c))).otherwise(0.0)


def has_code(c: Column) -> Column:
    return c.rlike(r"(?s)```.*?```")


def first_heading(c: Column) -> Column:
    return F.regexp_extract(c, r"(?m)^#+\s+(.+)$", 1)


#: Patterns of sensitive data.
SENSITIVE = r"(?i)\b\d{6}\b|api[_-]?key\s*[:=]\s*\S+|password\s*[:=]\s*\S+|token\s*[:=]\s*\S+|\b1[3-9]\d{9}\b"


def sensitive(c: Column) -> Column:
    return c.rlike(SENSITIVE)


#: What code may not hold, in any case.
DANGEROUS = (
    "import os", "import subprocess", "import sys", "os.system", "os.popen", "os.exec", "subprocess.call", "subprocess.Popen", "__import__", "eval(", "exec(",
    "require('child_process')", "require('fs')", "process.exit", "Deno.run", "rm -rf", "mkfs.", "dd if=", "> /dev/", "chmod", "chown", "sudo",
)


def dangerous(code: Column) -> Column:
    """Whether code holds one of DANGEROUS."""
    low = F.lower(code)
    return reduce(lambda a, p: a | F.contains(low, F.lit(p.lower())), DANGEROUS, F.lit(False))


def split_claims(c: Column) -> Column:
    """Sentences of more than three characters; the mark stays with its sentence."""
    parts = F.split(c, r"(?<=[。！？.!?\n])")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: F.length(x) > 3)


def ordered_distinct(c: Column) -> Column:
    """Values without later ones that differ in case only."""
    return F.aggregate(c, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def longest_first(c: Column) -> Column:
    """By length, longest first; equal lengths keep their order."""
    marked = F.transform(c, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(marked), lambda s: s["x"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where lengths differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
