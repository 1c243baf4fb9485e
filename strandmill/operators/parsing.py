"""From reads to CDR peptides: primer location, slicing, translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import hamming, is_valid_cdr, translate_codons

#: The primers of the protocol and the length of the CDR's ending.
HEAD = "TATTGCGCGCGT"
TAILS = {"tail_seq1_DY": "GACTACTGGGGTCAA", "tail_seq2_DY": "GACTACTGGGGCCAA", "tail_seq1_DV": "GACGTCTGGGGTCAA", "tail_seq2_DV": "GACGTCTGGGGCCAA"}
ENDING = 6


def primer_runs(primer: str, min_run: int) -> list[tuple[str, int]]:
    """(run, offset) of all parts of a primer of at least min_run bases, longest first, then leftmost."""
    return [(primer[i : i + n], i) for n in range(len(primer), min_run - 1, -1) for i in range(len(primer) - n + 1)]


def locate(seq: Column, primers: dict[str, str], mismatches: int = 3) -> Column:
    """struct(sstart, rank, qstart, qend, send, primer, score) of the best primer in a read, 1-based; null if none is found.

    A hit is an exact run of at least len(primer) - mismatches bases: where an aligner with +1 and -3 would accept a score
    of that much. The longest run counts, then the leftmost in the read, then the first primer. q is the primer, s the read.
    """
    levels: dict[int, list] = {}
    for rank, (name, primer) in enumerate(primers.items()):
        for run, offset in primer_runs(primer, len(primer) - mismatches):
            levels.setdefault(len(run), []).append((run, offset, name, rank))
    best = []
    for n in sorted(levels, reverse=True):  # shorter runs are only looked for where no longer one was found
        known = F.array(*[F.struct(F.lit(run).alias("run"), F.lit(offset).alias("offset"), F.lit(name).alias("primer"), F.lit(rank).alias("rank")) for run, offset, name, rank in levels[n]])
        hits = F.transform(known, _hit(seq, n))
        best.append(F.array_min(F.filter(hits, lambda h: h["sstart"] > 0)))
    return F.coalesce(*best)


def _hit(seq: Column, n: int):
    """Of a run of n bases: ordered by the place in the read, then by primer."""

    def hit(k: Column) -> Column:
        at = F.position(k["run"], seq)
        q = k["offset"] + 1
        return F.struct(at.alias("sstart"), k["rank"].alias("rank"), q.alias("qstart"), (k["offset"] + n).alias("qend"), (at + n - 1).alias("send"), k["primer"].alias("primer"), F.lit(n).alias("score"))

    return hit


def best_hits(hits: DataFrame, *, ident: str = "qseqid", evalue: str = "evalue") -> DataFrame:
    """One hit for each read: the least e-value, the smallest of all other columns on ties."""
    rest = [c for c in hits.columns if c not in (ident, evalue)]
    best = hits.groupBy(ident).agg(F.min(F.struct(evalue, *rest)).alias("x"))
    return best.select(ident, *[F.col(f"x.{c}").alias(c) for c in hits.columns if c != ident])


def cdr_slice(seq: Column, head: Column, tail: Column, header_len: int = len(HEAD), ending: int = ENDING) -> Column:
    """The CDR with its ending between the primers; null where the positions don't leave one."""
    start = head["send"] + header_len - head["qend"]
    stop = tail["sstart"] - tail["qstart"] + ending
    return F.when((start >= 0) & (stop > start), F.substring(seq, start + 1, stop - start))


def find_cdrs(reads: DataFrame, *, head: dict[str, str] | None = None, tails: dict[str, str] | None = None, mismatches: int = 3) -> DataFrame:
    """Reads (read_id, seq, ...) with cdr and peptide, for reads with both primers and a valid CDR. One narrow pass, no shuffle."""
    sides = F.struct(locate(F.col("seq"), head or {"head_seq": HEAD}, mismatches).alias("head"), locate(F.col("seq"), tails or TAILS, mismatches).alias("tail"))
    # each step inside a one-element array, so that a filter that is pushed down copies one expression, not all that it is made of
    cut = F.transform(F.array(sides), lambda s: F.when(s["head"].isNotNull() & s["tail"].isNotNull(), cdr_slice(F.col("seq"), s["head"], s["tail"])))
    valid = F.transform(cut, lambda c: F.when(is_valid_cdr(c), c))[0]
    return reads.withColumn("cdr", valid).where(F.col("cdr").isNotNull()).withColumn("peptide", translate_codons(F.col("cdr")))


def cdrs_from_hits(reads: DataFrame, head_hits: DataFrame, tail_hits: DataFrame, header_len: int = len(HEAD)) -> DataFrame:
    """The same from an aligner's best hits (qseqid, qstart, qend, sstart, send): reads with a hit on both sides.

    In the hits the read is the query of the search, so its columns are sstart and send of `cdr_slice` after the names are turned.
    """
    side = lambda hits, name: hits.select(F.col("qseqid").alias("read_id"), F.struct("qstart", "qend", "sstart", "send").alias(name))
    both = side(head_hits, "head").join(side(tail_hits, "tail"), "read_id")
    cut = reads.join(both, "read_id").withColumn("cdr", cdr_slice(F.col("seq"), F.col("head"), F.col("tail"), header_len))
    return cut.where(is_valid_cdr(F.col("cdr"))).withColumn("peptide", translate_codons(F.col("cdr"))).drop("head", "tail")


def matches_primer(part: Column, primer: str, most: int = 2) -> Column:
    """At most so many mismatches between a part of a read and an equally long primer; false for other lengths."""
    return F.coalesce(hamming(part, F.lit(primer)) <= most, F.lit(False))
