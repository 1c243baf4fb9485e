"""Neighbours by mismatches among equally long sequences, as equi-joins on shared segments."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.bits import bit_planes, mismatches, plane_names


def longest(df: DataFrame, seq: str = "seq") -> int:
    return df.agg(F.max(F.length(seq))).first()[0] or 1


def with_planes(df: DataFrame, max_len: int, seq: str = "seq") -> DataFrame:
    return df.select("*", F.length(seq).alias("len"), *bit_planes(F.col(seq), max_len))


def _segment(seq, length, i: int, k: int):
    """The i-th of k segments of a sequence."""
    start = lambda j: F.floor(length * j / k).cast("int")
    return F.substring(seq, start(i) + 1, start(i + 1) - start(i))


def in_cells(df: DataFrame, radius: int, agree: int = 1, seq: str = "seq") -> DataFrame:
    """Each row once for every choice of `agree` from radius + agree segments, with `cell` (length, choice, letters) and `choice` as bits.

    Two sequences with at most `radius` mismatches agree in at least `agree` whole segments, so they share a cell. More
    segments to agree in make more, but smaller cells. Segments can be empty; such agree.
    """
    k = radius + agree
    cells = [
        F.struct(F.lit(sum(1 << i for i in chosen)).alias("choice"), F.xxhash64("len", F.lit(n), *[_segment(F.col(seq), F.col("len"), i, k) for i in chosen]).alias("cell"))
        for n, chosen in enumerate(combinations(range(k), agree))
    ]
    return df.select("*", F.inline(F.array(*cells)))


def _is_first_choice(choice, a, b, length, radius: int, agree: int):
    """True if no other segment below the highest of the chosen ones agrees: the choice is the first that the pair shares."""
    k = radius + agree
    each = ((choice < 1 << (j + 1)) | (choice.bitwiseAND(1 << j) != 0) | (_segment(a, length, j, k) != _segment(b, length, j, k)) for j in range(k - 1))
    return reduce(lambda x, y: x & y, each, F.lit(True))


def close_to(queries: DataFrame, points: DataFrame, radius: int, max_len: int, *, also=None, agree: int = 1) -> DataFrame:
    """Joined rows, queries as `q` and points as `p`, that share a cell and have at most `radius` mismatches, with `dist`.

    Both sides come from with_planes, with sequences in upper case. Each pair comes once, from the cell of the first segments it agrees in. `also`: a further condition on q and p.
    """
    q, p = in_cells(queries, radius, agree).alias("q"), in_cells(points, radius, agree).alias("p")
    dist = mismatches("q", "p", max_len)
    on = (F.col("q.cell") == F.col("p.cell")) & (F.col("q.len") == F.col("p.len")) & (F.col("q.choice") == F.col("p.choice")) & (dist <= radius)
    if also is not None:
        on = on & also
    on = on & _is_first_choice(F.col("q.choice"), F.col("q.seq"), F.col("p.seq"), F.col("q.len"), radius, agree)
    return q.join(p, on).withColumn("dist", dist.cast("int"))


def hamming_pairs(df: DataFrame, radius: int, *, ident: str = "id", seq: str = "seq") -> DataFrame:
    """(src, dst, dist), src < dst, for all pairs of rows with equally long sequences and at most `radius` mismatches.

    Null sequences have no neighbours. Meant for distinct sequences: copies of a text give all their pairs.
    """
    rows = df.select(F.col(ident).alias("id"), F.upper(F.col(seq)).alias("seq")).where(F.col("seq").isNotNull() & F.col("id").isNotNull())
    max_len = longest(rows)
    rows = with_planes(rows, max_len)
    return close_to(rows, rows, radius, max_len, also=F.col("q.id") < F.col("p.id")).select(F.col("q.id").alias("src"), F.col("p.id").alias("dst"), "dist")


__all__ = ["close_to", "hamming_pairs", "in_cells", "longest", "plane_names", "with_planes"]
