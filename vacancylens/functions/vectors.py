"""Sets and vectors: overlap measures, dot products, the deterministic bag-of-words embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import col, let, words


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """|A∩B| / |A∪B| of distinct arrays; an empty side gives 0."""
    both = shared(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """|A∩B| / min(|A|, |B|) of distinct arrays; an empty side gives 0. Also the containment ratio."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, shared(a, b) / small).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """The vector at length one; a zero vector stays zero."""
    v = col(a)
    return let(norm(v), lambda n: F.transform(
        v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def word_buckets(c: Column | str, dim: int = fixed.EMBED_DIM) -> Column:
    """Bucket of every word: CRC32 modulo the dimension."""
    return F.transform(words(c), lambda w: (F.crc32(w.cast("binary")) % dim).cast("int"))


def bucket_counts(c: Column | str, dim: int = fixed.EMBED_DIM) -> Column:
    """ARRAY<INT> of word counts per bucket.

    Each word becomes one letter of an alphabet of `dim` letters; a bucket's count is how much shorter the text of
    letters gets without its letter. That is `dim` native string scans instead of words x dim lambda calls.
    """
    alphabet = "".join(chr(48 + i) if dim <= 79 else chr(0x4E00 + i) for i in range(dim))
    letters = F.array_join(
        F.transform(word_buckets(c, dim), lambda b: F.substring(F.lit(alphabet), b + 1, F.lit(1))), "")
    buckets = F.split(F.lit(alphabet), "")
    return let(letters, lambda s: F.transform(buckets, lambda a: F.length(s) - F.length(F.replace(s, a, F.lit("")))))


def hash_embed(c: Column | str, dim: int = fixed.EMBED_DIM) -> Column:
    """Unit bag-of-words vector: counts of CRC32(word) mod dim."""
    return let(bucket_counts(c, dim), unit)
