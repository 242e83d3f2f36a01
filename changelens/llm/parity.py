"""Parities of sets: a short bit field that bounds how many elements two sets differ in."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Long words of a bit field.
WORDS = 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def parities(u: np.ndarray, words: int = WORDS) -> list[int]:
    """Of 64 * words buckets of a set of hashes whether each holds an odd number of them. An element that only one
    of two sets has flips one bucket, so two sets have other parities in no more buckets than they differ in elements."""
    bucket = (mixed(u ^ np.uint64(0xBF58476D1CE4E5B9)) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(bucket, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def names(words: int = WORDS) -> list[str]:
    return [f"p{i}" for i in range(words)]


def unpacked(column: str, words: int = WORDS) -> list[Column]:
    """The words of an array column as columns of their own, which compiled code compares."""
    return [F.element_at(column, i + 1).alias(w) for i, w in enumerate(names(words))]


def flipped(prefix: str, words: int = WORDS) -> Column:
    """In how many buckets p0, p1, ... and the same columns with a prefix are not alike."""
    return reduce(Column.__add__, (F.bit_count(F.col(w).bitwiseXOR(F.col(prefix + w))) for w in names(words)))
