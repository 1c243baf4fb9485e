"""Problem 5: records of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.sequence import clean_sequence
from strandmill.operators.neighbors import part_keys, window_keys
from strandmill.plans.storage import Workspace

MAX_EDITS = 2
MIN_RESIDUES = 10
#: Size of one automaton, in passages, and of the texts that one task scans with it, in rows. Both are blocks of work, not limits.
SHARD_PASSAGES = 60_000
SCAN_ROWS = 100_000
#: So many shards are met by every text, as that costs less than working out the windows.
FEW_SHARDS = 16
#: Training texts with one passage that one task holds against the evaluation texts with it.
HOT_PASSAGE = 20_000


def normalised(rows: DataFrame, *extra: str, min_residues: int = MIN_RESIDUES) -> DataFrame:
    """id, clean sequence and extra columns of every record once; null ids and short sequences are left out."""
    kept = rows.select("id", clean_sequence(F.col("seq")).alias("text"), *extra)
    return kept.where(F.col("id").isNotNull() & (F.length("text") >= min_residues)).distinct()


def passages(texts: DataFrame, *, edits: int = MAX_EDITS) -> DataFrame:
    """(text, part, n, start, passage, passage_id): edits + 1 passages that cover each evaluation text of n residues.

    A text at most `edits` edits away contains at least one of them, moved by no more edits than can lie before it. Texts
    shorter than edits + 1 have empty passages, which nothing matches.
    """
    k = edits + 1
    bound = lambda i: F.floor(F.length("text") * i / k).cast("int")
    keyed = texts.select("text", F.col("text").alias("seq")).select("text", F.length("text").alias("n"), F.inline(part_keys(edits)))
    start = F.element_at(F.array(*[bound(i) for i in range(k + 1)]), F.col("part") + 1)
    stop = F.element_at(F.array(*[bound(i) for i in range(k + 1)]), F.col("part") + 2)
    return keyed.select("text", "part", "n", start.alias("start"), F.substring("text", start + 1, stop - start).alias("passage"), F.col("key").alias("passage_id")).where("passage <> ''")


def scan(eval_passages: DataFrame, train_texts: DataFrame, *, edits: int = MAX_EDITS) -> DataFrame:
    """(text, passage_id): training texts that contain a passage where an alignment with at most `edits` edits allows it.

    Passages are split into shards by their id. A training text goes to all of a few shards; of more to those of the ids that its own
    windows would have, at most 45 whatever the number of shards, and there into one of the shard's blocks; each block is one task, which
    builds the Aho-Corasick automaton of its shard and runs it over its texts. So the shuffle grows with the tables, not
    with their product, and every automaton and block stays bounded.
    """
    space = Workspace(train_texts.sparkSession, "scan")
    distinct, n = space.save_counted(eval_passages.select("passage_id", "part", "n", "start", "passage").distinct())
    shards = max(1, -(-n // SHARD_PASSAGES))
    shard = F.pmod(F.col("passage_id"), F.lit(shards)).cast("int").alias("shard")
    texts = train_texts.select("text", F.col("text").alias("seq"))
    routes = F.array_distinct(F.transform(window_keys(edits), lambda w: F.pmod(w["key"], F.lit(shards)).cast("int"))) if shards > FEW_SHARDS else F.sequence(F.lit(0), F.lit(shards - 1))
    routed = space.save(texts.select("text", F.explode(routes).alias("shard")))
    sizes = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SCAN_ROWS).cast("int").alias("blocks"))  # one row for each shard
    left = distinct.select("*", shard).join(sizes, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = routed.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("block"), "text")

    def run(key: tuple, found: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for ident, part, n, start, passage in found[["passage_id", "part", "n", "start", "passage"]].itertuples(index=False, name=None):
            uses = automaton.get(passage, None)
            if uses is None:
                automaton.add_word(passage, (len(passage), [(ident, part, n, start)]))
            else:
                uses[1].append((ident, part, n, start))
        rows: list[str] = []
        idents = array("q")
        if len(automaton) and len(texts):
            automaton.make_automaton()
            for text in texts["text"]:
                size = len(text)
                for ident in {i for end, (width, uses) in automaton.iter(text) for i, part, n, start in uses if _allowed(end + 1 - width - start, size - n, part, edits)}:
                    rows.append(text)
                    idents.append(ident)
        return pd.DataFrame({"text": pd.Series(rows, dtype=object), "passage_id": np.array(idents, dtype=np.int64)})

    grid = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    return grid.applyInPandas(run, "text string, passage_id bigint")


def _allowed(moved: int, longer: int, part: int, edits: int) -> bool:
    """A passage may have moved by the edits before it, and what follows it by the edits that are left."""
    return -part <= moved <= part and part - edits <= moved - longer <= edits - part


def near_texts(train: DataFrame, evaluation: DataFrame, *, edits: int = MAX_EDITS) -> DataFrame:
    """(train_text, eval_text, start, width): pairs of distinct texts at most `edits` edits apart, with each passage they share.

    Works on distinct texts: copies cost nothing here. Every candidate is held against the exact edit distance. Passages
    that very many training texts contain are split over tasks by those texts.
    """
    space = Workspace(train.sparkSession, "overlap")
    pieces = space.save(passages(evaluation.select("text").distinct(), edits=edits))
    hits = space.save(scan(pieces, train.select("text").distinct(), edits=edits))
    hot = hits.groupBy("passage_id").agg(F.ceil(F.count(F.lit(1)) / HOT_PASSAGE).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    left = hits.join(hot, "passage_id", "left").select("passage_id", F.col("text").alias("train_text"), F.pmod(F.xxhash64("text"), parts).cast("int").alias("s"))
    right = pieces.withColumnRenamed("text", "eval_text").join(hot, "passage_id", "left").withColumn("s", F.explode(F.sequence(F.lit(0), parts - 1)))
    pairs = left.join(right, ["passage_id", "s"])
    return pairs.where(F.levenshtein("train_text", "eval_text", edits) >= 0).select("train_text", "eval_text", "start", F.length("passage").alias("width"))


def overlapping_pairs(train: DataFrame, evaluation: DataFrame, *, edits: int = MAX_EDITS, min_residues: int = MIN_RESIDUES) -> DataFrame:
    """(id_a, id_b), id_a the smaller string, of all pairs of a training and an evaluation record that are near."""
    t, e = normalised(train, min_residues=min_residues), normalised(evaluation, min_residues=min_residues)
    near = near_texts(t, e, edits=edits).select("train_text", "eval_text").distinct()
    ids = near.join(t.select(F.col("id").alias("a"), F.col("text").alias("train_text")), "train_text").join(e.select(F.col("id").alias("b"), F.col("text").alias("eval_text")), "eval_text")
    return ids.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def coverage(train: DataFrame, evaluation: DataFrame, *, edits: int = MAX_EDITS, min_residues: int = MIN_RESIDUES) -> DataFrame:
    """id, part_name, source, n_train (near training records), covered: share of the text in merged matched intervals.

    One row for each evaluation record that is near any training record; copies are counted, not expanded into pairs.
    """
    t = normalised(train, min_residues=min_residues)
    e = normalised(evaluation, "part_name", "source", min_residues=min_residues)
    near = Workspace(train.sparkSession, "coverage").save(near_texts(t, e, edits=edits))
    spans = near.select("eval_text", "start", (F.col("start") + F.col("width")).alias("stop")).distinct()
    by_start = W.partitionBy("eval_text").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(by_start.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached))).groupBy("eval_text").agg((F.sum("new") / F.max(F.length("eval_text"))).alias("covered"))
    copies = t.groupBy(F.col("text").alias("train_text")).agg(F.count(F.lit(1)).alias("n"))
    partners = near.select("train_text", "eval_text").distinct().join(copies, "train_text").groupBy("eval_text").agg(F.sum("n").alias("n_train"))
    return e.withColumnRenamed("text", "eval_text").join(partners.join(covered, "eval_text"), "eval_text").select("id", "part_name", "source", "n_train", "covered")


def overlap_report(train: DataFrame, evaluation: DataFrame, **how: int) -> DataFrame:
    """part_name, source, n_records, n_overlapping, n_pairs, mean_covered for every part and source of the evaluation records."""
    records = evaluation.where(F.col("id").isNotNull()).select("id", "part_name", "source").distinct()
    found = coverage(train, evaluation, **how).groupBy("id", "part_name", "source").agg(F.sum("n_train").alias("n_train"), F.max("covered").alias("covered"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("id", "part_name", "source")]
    both = records.alias("r").join(found.alias("f"), on, "left")
    return both.groupBy("r.part_name", "r.source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("f.id").alias("n_overlapping"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_pairs"), F.coalesce(F.avg("covered"), F.lit(0.0)).alias("mean_covered")
    )


