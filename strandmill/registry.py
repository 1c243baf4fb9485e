"""Queries of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions.stats import collision_bounds
from strandmill.functions import sql
from strandmill.operators import affinity, cluster, counts, denoise, denoise_counts, density, ensemble, hamming, kmers, knn, metrics, neighbors, parsing, partition, permute
from strandmill.oracles import oracle_sql
from strandmill.plans.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]
ROUNDS = ["r1", "r2", "r3"]
#: Fixed component means and weights for the queries that denoise with a known mixture.
MEANS, WEIGHTS = [0.5, 8.0, 60.0], [0.6, 0.3, 0.1]

PARTS = {"train": 0.8, "valid": 0.1, "test": 0.1}

_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs of several queries -----------------------------------------------------------------------------------


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, seq of the read lines: each line once, headers left out."""
    return counts.distinct_lines(table(spark, sf_dir, "cluster_input")).where(F.col("seqs").isNotNull() & ~S.is_header(F.col("seqs"))).select("line_id", F.col("seqs").alias("seq"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, r1, r2, r3: the latest delivery of each sequence, 0 where unseen."""
    last = counts.latest(table(spark, sf_dir, "enrichment"), "seq", "loaded_at", *ROUNDS)
    return last.select("seq", *[F.when(F.col(r).isNull() | F.isnan(r), 0.0).otherwise(F.col(r) + 0.0).alias(r) for r in ROUNDS])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.labelled(rounds(spark, sf_dir))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, count: distinct clean sequences of the labelled peptides; id is the smallest number of an id, count the number of records."""
    both = peptides(spark, sf_dir, "knn_train").unionByName(peptides(spark, sf_dir, "knn_test"))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    return both.groupBy("seq").agg(F.min(number).alias("id"), F.count(F.lit(1)).alias("count")).select("id", "seq", "count")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, n: distinct upper-case DNA sequences of the latest rows; id is the smallest seq_id, n the number of reads."""
    last = counts.latest(table(spark, sf_dir, "cal_feat"), "seq_id", "loaded_at", "seq").where(F.col("seq").isNotNull())
    return last.groupBy(F.upper("seq").alias("seq")).agg(F.min("seq_id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "seq", "n")


def peptides(spark: SparkSession, sf_dir: str, name: str, *extra: str) -> DataFrame:
    """id, seq, extra of the labelled peptides: clean, not empty, each id once, by its latest row; of equally late ones the greatest."""
    t = table(spark, sf_dir, name)
    version = F.col("loaded_at") if "loaded_at" in t.columns else F.lit(None).cast("timestamp")
    rows = t.select("id", version.alias("loaded_at"), S.clean_sequence(F.col("seq")).alias("seq"), *extra)
    rows = rows.where(F.col("id").isNotNull() & (F.length("seq") > 0))
    return counts.latest(rows, "id", "loaded_at", *[c for c in rows.columns if c not in ("id", "loaded_at")])


def asked(df: DataFrame) -> DataFrame:
    """The stated query set of searches: every row whose id's number is divisible by 100."""
    return df.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 100 == 0)


# ---- counting and labelling --------------------------------------------------------------------------------------


@query
def q01_read_counts(spark, d):
    return counts.read_counts(reads(spark, d))


@query
def q01_line_counts(spark, d):
    """Every stripped line, headers included."""
    return counts.read_counts(counts.distinct_lines(table(spark, d, "cluster_input")), "seqs")


@query
def q01_distinct_sequences(spark, d):
    return reads(spark, d).select(F.trim("seq").alias("seq")).distinct()


@query
def q02_round_counts_long(spark, d):
    return counts.long_counts(rounds(spark, d), ROUNDS)


@query
def q03_enrichment_outer(spark, d):
    return counts.enrichment(counts.long_counts(rounds(spark, d), ROUNDS), ROUNDS)


@query
def q04_enrichment_ratio(spark, d):
    return rounds(spark, d).select("seq", F.round(counts.enrichment_ratio(F.col("r2"), F.col("r3")), 6).alias("ratio"))


@query
def q05_support_filter(spark, d):
    t = rounds(spark, d)
    return t.where(counts.usable_peptide(F.col("seq")) & counts.supported(F.col("r1"), F.col("r2"), F.col("r3")))


@query
def q06_class_labels(spark, d):
    return labelled(spark, d).select("seq", "r1", "r2", "r3", F.round("ratio", 6).alias("ratio"), "l", "l2")


@query
def q07_label_balance(spark, d):
    return labelled(spark, d).groupBy("l", F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))


@query
def q08_events_rounds(spark, d):
    """Users as sequences, weeks as rounds: the merge of rounds on another table."""
    week = F.concat(F.lit("w"), F.least(F.floor((F.dayofyear("ts") - 1) / 7), F.lit(3)).cast("string"))
    e = table(spark, d, "events").where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("seq"), week.alias("round")).agg(F.count(F.lit(1)).alias("n"))
    return counts.enrichment(e, ["w0", "w1", "w2", "w3"])


@query
def q29_positive_in_either_round(spark, d):
    return counts.positive_in_either(rounds(spark, d), "r1", "r2")


# ---- expressions -------------------------------------------------------------------------------------------------


@query
def q09_centre_pad(spark, d):
    p = peptides(spark, d, "knn_train")
    return p.select("id", S.centre_pad(F.col("seq")).alias("padded"), S.centre_pad(F.col("seq"), overlong_as_reference=True).alias("padded_as_reference"), S.right_repad(F.col("seq"), 20).alias("right_padded"))


@query
def q10_one_hot_sum(spark, d):
    """Peptides longer than the width have as many places as residues."""
    p = peptides(spark, d, "knn_train").withColumn("hot", S.one_hot(F.col("seq")))
    hot = F.col("hot")
    total = F.aggregate(hot, F.lit(0.0).cast("float"), lambda a, x: a + x).cast("int")
    low, high = S.window_bounds(F.col("seq"))
    return p.select("id", total.alias("residues"), S.argmax_label(hot).alias("first_place"), F.size(hot).alias("width"), low.alias("low"), high.alias("high"))


@query
def q11_translate_codons(spark, d):
    return dna(spark, d).where(S.is_valid_cdr(F.col("seq"))).select("id", S.translate_codons(F.col("seq")).alias("peptide"))


@query
def q12_kmer_counts(spark, d):
    return kmers.kmer_counts(peptides(spark, d, "knn_train"))


# ---- neighbours --------------------------------------------------------------------------------------------------


@query
def q13_lev_neighbors(spark, d):
    return neighbors.levenshtein_pairs(seeds(spark, d), 2)


@query
def q14_hamming_neighbors(spark, d):
    return hamming.hamming_pairs(dna(spark, d), 3)


@query
def q15_nearest_match(spark, d):
    return neighbors.nearest(asked(peptides(spark, d, "knn_test")), peptides(spark, d, "knn_train"))


@query
def q16_nearest_match_shift(spark, d):
    return neighbors.nearest(asked(peptides(spark, d, "knn_test")), peptides(spark, d, "knn_train"), mode="shift")


@query
def q17_one_to_all(spark, d):
    return neighbors.one_to_all(seeds(spark, d), "ARDYYGSGSYYFDY").select("id", "dist")


@query
def q18_rho_delta(spark, d):
    return density.rho_delta(dna(spark, d)).select("id", "rho", "delta")


@query
def q19_density_assign(spark, d):
    f = density.rho_delta(dna(spark, d))
    return density.assign(f, density.centres(f, min_rho=5, min_delta=5))


@query
def q20_max_neighbor_count(spark, d):
    return denoise.max_neighbour_counts(dna(spark, d)).drop("seq")


@query
def q21_noise_probability(spark, d):
    p = denoise.noise_probabilities(denoise.max_neighbour_counts(dna(spark, d)))
    return p.select("id", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "p3", "p_max")])


@query
def q22_noise_centers(spark, d):
    rows = dna(spark, d)
    p = denoise.noise_probabilities(denoise.max_neighbour_counts(rows), any_way=True)
    n = counts.latest(table(spark, d, "cal_feat"), "seq_id", "loaded_at", "seq").select(F.upper("seq").alias("seq"))
    return denoise.real_reads(p, denoise.distinct_line_count(n, "seq")).select("id", F.round("p_max", 6).alias("p_max"))


@query
def q23_replicate_accept(spark, d):
    """Two replicates: reads with odd and with even seq_id."""
    last = counts.latest(table(spark, d, "cal_feat"), "seq_id", "loaded_at", "seq").where(F.col("seq").isNotNull())
    sides = []
    for parity in (1, 0):
        rows = last.where(F.col("seq_id") % 2 == parity).groupBy(F.upper("seq").alias("seq")).agg(F.min("seq_id").alias("id"), F.count(F.lit(1)).alias("n"))
        sides.append(denoise.noise_probabilities(denoise.max_neighbour_counts(rows)).select("seq", F.col("p_max").alias("p")))
    return denoise.accepted_in_replicates(*sides).select("seq", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "p")])


# ---- clusters ----------------------------------------------------------------------------------------------------


@query
def q24_components(spark, d):
    s = cluster.ranked(seeds(spark, d)).where(F.col("rank").isNotNull())
    return cluster.seed_groups(s)


@query
def q25_nonseed_projection(spark, d):
    """1,000 seeds, so that there are others to project."""
    s = cluster.ranked(seeds(spark, d), 1_000)
    first, rest = s.where(F.col("rank").isNotNull()), s.where(F.col("rank").isNull())
    return cluster.project(rest, first, cluster.seed_groups(first))


@query
def q26_clusters_output(spark, d):
    return cluster.cluster(seeds(spark, d))


@query
def q27_topn_seeds(spark, d):
    return cluster.ranked(seeds(spark, d), 1_000).where(F.col("rank").isNotNull()).select("id", "seq", "rank")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, group of all clustered rows; a row without a group is one of its own."""
    group = F.when(F.col("group_id") > 0, F.concat(F.lit("g"), F.col("group_id"))).otherwise(F.concat(F.lit("r"), F.col("row_id")))
    return table(spark, sf_dir, "cluster_partition").where(F.col("row_id").isNotNull()).select("row_id", group.alias("group")).distinct()


@query
def q28_partition_sizes(spark, d):
    rows = grouped(spark, d)
    return partition.expand(partition.partition_groups(rows, PARTS), rows).select("row_id", "part")


@query
def q28_partition_check(spark, d):
    """Whether the parts have their sizes and no group is parted."""
    rows = grouped(spark, d)
    return partition.partition_check(partition.expand(partition.partition_groups(rows, PARTS), rows), rows, PARTS)


# ---- counts with background --------------------------------------------------------------------------------------


@query
def q30_count_denoise(spark, d):
    return denoise_counts.denoise(rounds(spark, d), "r3", MEANS, WEIGHTS, out="clean").select("seq", "r3", "clean")


@query
def q31_mixture_select(spark, d):
    """Components of the counts of a round, over sequences seen in it or in the round before."""
    both = counts.positive_in_either(rounds(spark, d), "r1", "r2")
    return denoise_counts.mixtures(both, "r2").select("components", F.round("score", 3).alias("score"), "means", "weights")


@query
def q32_affinities(spark, d):
    return affinity.joint_affinities(affinity.batches(peptides(spark, d, "knn_train")))


@query
def q33_permute(spark, d):
    """The training row of the same number is the proposal of a test row."""
    rows = peptides(spark, d, "knn_test")
    return permute.permuted(rows, permute.distance_summary(permute.paired(rows, peptides(spark, d, "knn_train"))), trials=3)


@query
def q37_collision_bound(spark, d):
    """The bound of the chance of a collision among as many random strings as there are sequences of each length."""
    by = seeds(spark, d).groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("bound", F.round(collision_bounds(F.col("n"), F.col("len"), 20, 2), 6))


# ---- models ------------------------------------------------------------------------------------------------------


@query
def q34_ensemble_vote(spark, d):
    """Six simple rules vote on every peptide; three such votes make the call."""
    n = F.length("seq")
    rules = [(n % 2 == 0), (n > 14), F.col("seq").startswith("AR"), F.col("seq").endswith("DY"), F.contains("seq", F.lit("W")), (n % 3 == 0)]
    vote = metrics.majority([r.cast("int") for r in rules])
    two = metrics.majority([rules[i].cast("int") for i in (0, 2, 4)])
    three = metrics.majority([rules[i].cast("int") for i in (1, 3, 5)])
    return peptides(spark, d, "knn_train").select("id", vote.alias("vote"), metrics.nonspecific(vote, two, three).alias("call"))


@query
def q35_knn_regression(spark, d):
    """knn_test rows of the query set against all training rows with a target."""
    train = peptides(spark, d, "knn_train", F.col("target_num").alias("target")).where(F.col("target").isNotNull() & ~F.isnan("target"))
    near = knn.k_nearest(asked(peptides(spark, d, "knn_test")), train)
    return knn.predicted(near).select("id", F.round("prediction", 6).alias("prediction"))


@query
def q36_primer_locate_cdr(spark, d):
    """Reads built from the DNA: both primers around each sequence, one base of the head replaced in a third of them."""
    head = F.when(F.col("id") % 3 == 0, F.concat(F.lit(parsing.HEAD[:2]), F.lit("A"), F.lit(parsing.HEAD[3:]))).otherwise(F.lit(parsing.HEAD))
    tail = F.when(F.col("id") % 2 == 0, parsing.TAILS["tail_seq1_DY"]).otherwise(parsing.TAILS["tail_seq2_DV"])
    made = dna(spark, d).select(F.col("id").alias("read_id"), F.concat(F.lit("CCATGG"), head, "seq", tail, F.lit("CC")).alias("seq"))
    return parsing.find_cdrs(made).select("read_id", "cdr", "peptide")


def _held_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """k-mer vectors of the labelled sequences: four fifths to fit on, one to score, by a hash of the sequence."""
    rows = labelled(spark, d).select(F.xxhash64("seq").alias("id"), "seq", F.col("l").cast("double").alias("label"))
    vectors = Workspace(spark, "kmers").save(kmers.kmer_vectors(rows))
    test = F.pmod("id", F.lit(5)) == 0
    return vectors.where(~test), vectors.where(test)


@query
def q38_kmer_model(spark, d):
    """Logistic regression on k-mers, scored on rows it hasn't seen: confusion and AUC."""
    train, test = _held_out(spark, d)
    scored = kmers.logistic_cv(train).transform(test).select("label", "prediction", vector_to_array("rawPrediction")[1].alias("score"))
    scored = Workspace(spark, "scored").save(scored)
    return metrics.confusion(scored).crossJoin(metrics.roc_auc(scored))


@query
def q38_kmer_svm(spark, d):
    """A linear machine on the same k-mers, scored on rows it hasn't seen."""
    train, test = _held_out(spark, d)
    return metrics.confusion(kmers.linear_svm(train).transform(test).select("label", "prediction"))


@query
def q38_kmer_totals(spark, d):
    """How often each k-mer occurs in the vectors of the training peptides."""
    return kmers.kmer_totals(kmers.kmer_vectors(peptides(spark, d, "knn_train"), keep=()))


@query
def q38_kmer_forest(spark, d):
    """A regression forest on the k-mers of the training rows, over all test rows with a target."""
    rows = lambda name: peptides(spark, d, name, F.col("target_num").alias("label")).where(F.col("label").isNotNull() & ~F.isnan("label"))
    model = kmers.forest(kmers.kmer_vectors(rows("knn_train")), regression=True)
    return model.transform(kmers.kmer_vectors(rows("knn_test"))).select("id", "label", "prediction")


@query
def q39_network_ensemble(spark, d):
    """Six networks fitted on a bounded sample of labelled rows, applied to all of them: their mean, their vote, the call."""
    rows = labelled(spark, d).select(F.col("seq").alias("id"), "seq", F.col("l").alias("label"))
    scored = ensemble.predict(rows, ensemble.train_ensemble(rows))
    return scored.select("id", "mean_p", "vote", metrics.nonspecific(F.col("vote")).alias("call"))


@query
def q40_ratio_auc(spark, d):
    """How well the first two rounds tell the label of the third."""
    scored = labelled(spark, d).select(F.col("l").alias("label"), counts.enrichment_ratio(F.col("r1"), F.col("r2")).alias("score"))
    return metrics.roc_auc(scored).select(F.round("auc", 6).alias("auc"))


@query
def q41_sql_functions(spark, d):
    """The registered SQL functions over all labelled peptides."""
    sql.register(spark)
    peptides(spark, d, "knn_train").createOrReplaceTempView("strandmill_peptides")
    return spark.sql("SELECT id, centre_pad(seq, 20, 'J') AS padded, hamming(seq, reverse(seq)) AS turned, shift_distance(seq, 'ARDY') AS shifted FROM strandmill_peptides")


def queries() -> dict[str, Query]:
    from strandmill import file_queries  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


__all__ = ["oracle_sql", "queries"]
