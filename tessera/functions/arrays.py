"""Column builders for arrays: vectors, sets, n-grams, token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(x) * norm(y)
    return F.when(size == 0, 0.0).otherwise(dot(x, y) / F.nullif(size, F.lit(0.0)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))))


def set_overlap(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(true positives, false positives, false negatives) of x against y, as sets."""
    hit = F.size(F.array_intersect(x, y))
    return hit, F.size(F.array_distinct(x)) - hit, F.size(F.array_distinct(y)) - hit


def set_f1(x: Column, y: Column) -> Column:
    """F1 of two sets: 1 if both are empty, 0 if one is."""
    hit, extra, lost = set_overlap(x, y)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * hit / (2.0 * hit + extra + lost))


def jaccard(x: Column, y: Column) -> Column:
    """Share of common elements; 0 if the union is empty or one side is."""
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    count = F.size(words) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))


def append_new(x: Column, y: Column) -> Column:
    """x and what y adds to it, in order of first appearance."""
    return F.array_distinct(F.concat(x, y))


def mask_padding(ids: Column, pad: int) -> Column:
    """Attention mask: 1 where the id isn't padding."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def label_ids(ids: Column, pad: int, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def repair_ids(ids: Column, vocabulary: int, unknown: int | None = None) -> Column:
    """Ids outside the vocabulary become ``unknown``, or the nearest valid id."""
    fixed = (lambda x: F.lit(unknown)) if unknown is not None else (lambda x: F.greatest(F.lit(0), F.least(x, F.lit(vocabulary - 1))))
    return F.transform(ids, lambda x: F.when((x < 0) | (x >= vocabulary), fixed(x)).otherwise(x))


def repair_labels(ids: Column, vocabulary: int, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when((x != ignore) & ((x < 0) | (x >= vocabulary)), F.lit(ignore)).otherwise(x))


def invalid_ids(ids: Column, vocabulary: int) -> Column:
    return F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocabulary)))


def shift_right(labels: Column, start: int, pad: int, ignore: int = -100) -> Column:
    """Decoder input: the start id, then all labels but the last, ignored ones as padding."""
    filled = F.transform(labels, lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x))
    return F.concat(F.array(F.lit(start).cast("long")), F.slice(filled, 1, F.greatest(F.size(filled) - 1, F.lit(0))))


def pad_right(ids: Column, width: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(width - F.size(ids), F.lit(0))))


def completion_mask(ids: Column, end: int) -> Column:
    """1 up to and with the first end id; all 1 without one."""
    at = F.array_position(ids, F.lit(end))
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values where the mask is 1; null if it is 1 nowhere."""
    kept = total(mask)
    return dot(values, mask) / F.nullif(kept, F.lit(0.0))
