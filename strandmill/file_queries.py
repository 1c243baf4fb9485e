"""Queries that write tables derived from the given ones in the formats of other tools, and read them back with the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.operators import cluster, counts, denoise, denoise_counts, neighbors, parsing, permute
from strandmill.plans.storage import Workspace
from strandmill.registry import asked, dna, peptides, query, reads, rounds, seeds, table
from strandmill.sources import readers, writers

#: The rounds that the reads of the flagship query fall into, by number.
FLAGSHIP_ROUNDS = ["R1", "R2", "R3"]


def _folder(spark, name: str) -> str:
    return Workspace(spark, name).root


def primed(seq: Column, number: Column) -> Column:
    """A read as the sequencer gives it: both primers around a sequence, one base of the head replaced in a third of them."""
    head = F.when(number % 3 == 0, F.concat(F.lit(parsing.HEAD[:2]), F.lit("A"), F.lit(parsing.HEAD[3:]))).otherwise(F.lit(parsing.HEAD))
    tail = F.when(number % 2 == 0, parsing.TAILS["tail_seq1_DY"]).otherwise(parsing.TAILS["tail_seq2_DV"])
    return F.concat(F.lit("CCATGG"), head, seq, tail, F.lit("CC"))


def hits_of(made: DataFrame, primers: dict[str, str]) -> DataFrame:
    """Tabular alignment hits of reads (read_id, seq) with the primers, with a worse one beside each."""
    found = made.select("read_id", parsing.locate(F.col("seq"), primers).alias("h")).where("h IS NOT NULL")
    row = lambda evalue, shift: found.select(F.col("read_id").cast("string").alias("qseqid"), F.col("h.primer").alias("sseqid"), F.lit(100.0).alias("pident"), F.col("h.score").alias("length"), F.lit(0).alias("mismatch"), F.lit(0).alias("gapopen"), "h.qstart", "h.qend", (F.col("h.sstart") + shift).alias("sstart"), (F.col("h.send") + shift).alias("send"), F.lit(evalue).alias("evalue"), F.col("h.score").cast("double").alias("bitscore"))
    return row(1e-5, 0).unionByName(row(1e-2, 3))


@query
def q43_fastq_round_trip(spark, d):
    """All DNA as FASTQ, one half gzipped, the other plain, read as one set."""
    folder = _folder(spark, "fastq")
    rows = dna(spark, d).select(F.concat_ws(" ", F.concat_ws("#", F.lit("run"), F.concat_ws(":", "id", "n")), F.lit("1:N:0")).alias("read_id"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), (F.col("id") % 2).alias("half"))
    for half in (0, 1):
        writers.write_fastq(rows.where(F.col("half") == half), f"{folder}/h{half}", packed=half == 0)
    return readers.read_fastq(spark, folder, glob="part-*").select("read_id", "seq", "qual")


@query
def q44_fasta_round_trip(spark, d):
    """Training peptides as FASTA, in files of 2,000 records, with notes in the headers."""
    folder = _folder(spark, "fasta")
    named = peptides(spark, d, "knn_train").select(F.concat(F.col("id"), F.lit(" note > more")).alias("read_id"), "seq")
    writers.write_fasta(named, folder, records_per_file=2_000)
    return readers.read_fasta(spark, folder, glob="part-*").select("read_id", "seq")


@query
def q45_cdrs_from_hits(spark, d):
    """Hits of both primers as an aligner's tables, read back, the best hit of each read, both sides joined, CDR and peptide."""
    folder = _folder(spark, "hits")
    made = Workspace(spark, "made").save(dna(spark, d).select(F.col("id").cast("string").alias("read_id"), primed(F.col("seq"), F.col("id")).alias("seq")))
    sides = []
    for name, primers in (("head", {"head_seq": parsing.HEAD}), ("tail", parsing.TAILS)):
        hits_of(made, primers).write.csv(f"{folder}/{name}", sep="\t")
        sides.append(parsing.best_hits(readers.read_hits(spark, f"{folder}/{name}")))
    return parsing.cdrs_from_hits(made, *sides).select(F.col("read_id").cast("bigint").alias("read_id"), "cdr", "peptide")


@query
def q46_flagship(spark, d):
    """From reads to labels: reads of three rounds, CDRs, peptides, counts by round, the merged table, support, labels."""
    last = counts.latest(table(spark, d, "cal_feat"), "seq_id", "loaded_at", "seq").where(F.col("seq").isNotNull())
    round_ = F.element_at(F.array(*[F.lit(r) for r in FLAGSHIP_ROUNDS]), (F.pmod("seq_id", F.lit(3)) + 1).cast("int"))
    made = last.select(F.col("seq_id").alias("read_id"), round_.alias("round"), primed(F.upper("seq"), F.col("seq_id")).alias("seq"))
    # written once: filters on the peptide, pushed below it, would work it out again for each of its uses
    found = Workspace(spark, "found").save(parsing.find_cdrs(made).select("round", F.col("peptide").alias("seq")))
    merged = counts.enrichment(counts.round_counts(found), FLAGSHIP_ROUNDS)
    return counts.labelled(merged.withColumnsRenamed({"R1": "r1", "R2": "r2", "R3": "r3"})).select("seq", "r1", "r2", "r3", F.round("ratio", 6).alias("ratio"), "l", "l2")


@query
def q47_aligned_targets(spark, d):
    """Training peptides and targets as line-aligned files, joined by line."""
    folder = _folder(spark, "targets")
    rows = peptides(spark, d, "knn_train", F.coalesce("target_num", F.lit(0.0)).alias("target")).where(~F.isnan("target"))
    writers.write_targets(rows, folder, order="id", columns=["id", "seq"], target="target")
    return readers.read_targets(spark, folder, seq_column=1).select("row_idx", "seq", F.col("target")[0].alias("target"))


@query
def q48_text_columns(spark, d):
    """The merged rounds as tab-separated text with a header, read by position and by name."""
    folder = _folder(spark, "columns")
    writers.write_tsv(rounds(spark, d), folder)
    place = readers.read_columns(spark, folder, ["seq", "r1", "r2", "r3"], skip=1).select("seq", F.col("r1").cast("double").alias("r1"), F.col("r2").cast("double").alias("r2"))
    named = spark.read.csv(folder, sep="\t", header=True, schema="seq string, r1 double, r2 double, r3 double").select("seq", "r3")
    return place.join(named, "seq")


@query
def q49_replicate_files(spark, d):
    """Chances of two replicates (odd and even seq_id) as files of a folder each, scanned and accepted jointly."""
    folder = _folder(spark, "replicates")
    last = counts.latest(table(spark, d, "cal_feat"), "seq_id", "loaded_at", "seq").where(F.col("seq").isNotNull())
    for parity in (1, 0):
        rows = last.where(F.col("seq_id") % 2 == parity).groupBy(F.upper("seq").alias("seq")).agg(F.min("seq_id").alias("id"), F.count(F.lit(1)).alias("n"))
        chances = denoise.noise_probabilities(denoise.max_neighbour_counts(rows)).select(F.concat_ws(" ", "seq", "p_max").alias("value"))
        chances.unionByName(spark.range(1).select(F.lit(">header 0.0").alias("value"))).write.text(f"{folder}/rep{parity}.probs")
    scanned = Workspace(spark, "scanned").save(readers.read_replicates(spark, folder, ["seq", "p"], glob="part-*").withColumn("p", F.col("p").cast("double")))
    side = lambda parity: scanned.where(F.col("replicate") == f"rep{parity}.probs").drop("replicate")
    return denoise.accepted_in_replicates(side(1), side(0)).select("seq", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "p")])


@query
def q50_sample_files(spark, d):
    """Reads of four samples, one a line in a folder for each, then the counts of each sample as a partitioned table."""
    folder = _folder(spark, "samples")
    rows = reads(spark, d).select(F.concat(F.lit("s"), F.pmod(F.coalesce("line_id", F.lit(0)), F.lit(4)).cast("string")).alias("sample"), F.trim("seq").alias("seq")).where("seq <> '' AND NOT contains(seq, '\\n') AND NOT contains(seq, '\\r')")
    writers.write_reads(rows, f"{folder}/reads")
    back = spark.read.text(f"{folder}/reads").withColumnRenamed("value", "seq")
    writers.write_counts(counts.read_counts(back, "seq", "sample"), f"{folder}/counts")
    return spark.read.parquet(f"{folder}/counts").select("sample", "seq", "n")


@query
def q51_cluster_files(spark, d):
    """Clusters as a table, as assignments and as named parts, all read back: each row with its group by every file."""
    folder = _folder(spark, "clusters")
    made = Workspace(spark, "made").save(cluster.cluster(seeds(spark, d)))
    writers.write_tsv(made.select("seq", "count", "group", "group_size"), f"{folder}/table")
    writers.write_assignments(made, f"{folder}/members")
    writers.write_parts(made.select("id", F.when(F.col("group_size") > 1, "shared").otherwise("single").alias("part")), f"{folder}/parts")
    t = spark.read.csv(f"{folder}/table", sep="\t", header=True, schema="seq string, count bigint, group bigint, group_size int")
    assign = spark.read.csv(f"{folder}/members/assign", sep="\t", schema="id bigint, group bigint")
    clust = spark.read.csv(f"{folder}/members/clust", sep="\t", schema="group bigint, id bigint")
    part = spark.read.csv(f"{folder}/parts", sep="\t", header=True, schema="id bigint, part string")
    by_id = assign.join(clust, ["id", "group"]).join(part, "id")
    return made.select("id", "seq").join(t, "seq").join(by_id, ["id", "group"]).select("id", "seq", "count", "group", "group_size", "part")


@query
def q52_primer_check(spark, d):
    """Mismatches of the first twelve bases with the head primer, and whether they are few."""
    part = F.substring("seq", 1, len(parsing.HEAD))
    return dna(spark, d).select("id", S.hamming(part, F.lit(parsing.HEAD)).alias("misses"), parsing.matches_primer(part, parsing.HEAD, most=6).alias("matches"))


@query
def q53_strip_and_share(spark, d):
    """Padding stripped from reads, and the share of places at which each read differs from itself turned round."""
    bare = reads(spark, d).select("line_id", S.strip_chars(F.col("seq"), "J*- ").alias("bare")).where("bare <> ''")
    return bare.select("bare", F.round(S.hamming_share(F.col("bare"), F.reverse("bare")), 6).alias("share")).distinct()


@query
def q54_similarity_file(spark, d):
    """Nearest matches written in the order of their distance, read back with the place in the file."""
    folder = _folder(spark, "similarity")
    near = neighbors.nearest(asked(peptides(spark, d, "knn_test")), peptides(spark, d, "knn_train"))
    near.orderBy("mindist", "id").select(F.concat_ws("\t", "id", "seq", "closest_target", "mindist").alias("value")).write.text(folder)
    p = F.split("value", "\t")
    return readers.read_numbered(spark, folder).select(F.col("line").alias("place"), p[0].alias("id"), p[2].alias("closest_target"), p[3].cast("int").alias("mindist"))


@query
def q55_denoise_stats(spark, d):
    """Rows seen before and after the background of the third round is taken away."""
    from strandmill.registry import MEANS, WEIGHTS

    before = rounds(spark, d)
    return denoise_counts.stats(before, denoise_counts.denoise(before, "r3", MEANS, WEIGHTS), "r3")


@query
def q56_paired_distances(spark, d):
    """Seed i and proposal i, whatever their distance: how often each distance occurs for each length."""
    return permute.distance_summary(permute.paired(peptides(spark, d, "knn_test"), peptides(spark, d, "knn_train")))


@query
def q57_equality_probe(spark, d):
    """The seed that is the target itself: distance 0 to the first of all sequences."""
    s = seeds(spark, d)
    first = s.agg(F.min("seq").alias("target"))
    return neighbors.one_to_all(s.crossJoin(F.broadcast(first)), F.col("target")).where("dist = 0").select("id", "seq")
