import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import density_clusters, grouped_splits, heavy_hitters, linked_groups, split_overlap, term_counts
from strandmill.llm.linked_groups import boruvka

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misses(a, b):
    return sum(x != y for x, y in zip(a, b))


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


# ---- 1: terms ----------------------------------------------------------------------------------------------------

RECORDS = "key string, version timestamp, terms array<bigint>, deleted boolean"


def brute_terms(batches):
    state = {}
    for batch in batches:
        for key, version, terms, deleted in batch:
            new = (version or dt.datetime.min, [t for t in terms if t is not None], bool(deleted))
            if key is not None and (key not in state or new > state[key]):
                state[key] = new
    live = [t for _, t, gone in state.values() if not gone]
    return {str(x): (sum(t.count(x) for t in live), sum(x in t for t in live)) for t in live for x in t}, len(live)


def test_terms_follow_changes_and_deletions(spark):
    rng = random.Random(3)
    batches = []
    for b in range(4):
        rows = [(rng.choice("abcdefgh"), day(b * 10 + rng.randrange(15)), [rng.choice([0, 1, 2, 3, None]) for _ in range(3)], rng.random() < 0.2) for _ in range(12)]
        batches.append([*rows, rows[0], (None, day(1), [1], False), ("z", None, [7, 7], None)])
    counts = term_counts.TermCounts(spark)
    for i, batch in enumerate(batches):
        counts.apply(spark.createDataFrame(batch, RECORDS))
        want, n = brute_terms(batches[: i + 1])
        got = counts.counts.collect()
        assert {r["term"]: (r["n_occurrences"], r["n_records"]) for r in got if r["term"] is not None} == want
        assert [r["n_records"] for r in got if r["term"] is None] == [n]
    before = sorted(map(tuple, counts.counts.collect()), key=str)
    counts.apply(spark.createDataFrame([], RECORDS))
    assert sorted(map(tuple, counts.counts.collect()), key=str) == before


def test_terms_of_fields(spark):
    rows = [("a", 1.0, None, float("nan"), day(1)), ("a", 1.0, None, float("nan"), day(1)), ("b", -0.0, 0.0, float("inf"), None), (None, 5.0, 5.0, 5.0, day(2)), ("c", None, None, None, day(3))]
    df = spark.createDataFrame(rows, "seq string, r1 double, r2 double, r3 double, loaded_at timestamp").withColumn("term", F.lit("x")).withColumn("key", F.lit(1))
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["is_rare"], r["is_common"]) for r in term_counts.count_in_deliveries(df, key="seq", version="loaded_at", fields=["r1", "r2", "r3"]).table().collect()}
    assert got == {"1": (1, 1, True, True), "0": (2, 1, True, True)}
    assert term_counts.count_in_deliveries(df.limit(0), key="seq", version="loaded_at", fields=["r1"]).table().count() == 0


def test_terms_of_any_type_go_on_in_a_later_session(spark, tmp_path):
    folder = f"file://{tmp_path}/terms"
    words = lambda rows: spark.createDataFrame(rows, "key string, version timestamp, terms array<string>, deleted boolean")
    first = [(f"k{i}", day(1), ["gamma", f"w{i % 7}", "gamma"], False) for i in range(200)]
    term_counts.TermCounts(spark, folder, buckets=8).apply(words(first))
    later = term_counts.TermCounts(spark.newSession(), folder)  # nothing but the folder is known to it
    assert later.buckets == 8 and len(later.state["log"]) == 8
    before = dict(later.state["log"]), dict(later.state["counts"])
    later.apply(words([("k3", day(2), ["delta"], False), ("k4", day(0), ["old"], False)]))
    moved = [b for b, v in later.state["log"].items() if before[0][b] != v]
    assert 1 <= len(moved) <= 2  # only the buckets of k3 and k4 were read and rewritten
    assert 0 < len([b for b, v in later.state["counts"].items() if before[1].get(b) != v]) <= 4
    want = {k: v for k, v in brute_terms([first, [("k3", day(2), ["delta"], False)]])[0].items()}
    third = term_counts.TermCounts(spark, folder)
    assert {r["term"]: (r["n_occurrences"], r["n_records"]) for r in third.counts.collect() if r["term"] is not None} == want
    assert [r["n_records"] for r in third.counts.where("term IS NULL").collect()] == [200]
    fractions = spark.createDataFrame([("a", 2.5, 2.0)], "seq string, r1 double, r2 double").withColumn("t", term_counts.field_terms("r1", "r2"))
    assert fractions.first()["t"] == ["2.5", "2"]


def test_a_long_record_is_tallied(spark):
    counts = term_counts.TermCounts(spark)
    counts.apply(spark.createDataFrame([("a", day(1), [f"t{i % 30_000}" for i in range(60_000)])], "key string, version timestamp, terms array<string>"))
    assert counts.counts.agg(F.count("term"), F.min("n_occurrences"), F.max("n_records")).first() == (30_000, 2, 1)


# ---- 2: frequent items -------------------------------------------------------------------------------------------


def test_frequent_sequences(spark):
    rows = [(i, "A" if i % 3 == 0 else f" a{'cdefg'[i % 5]}- ", float(i % 4)) for i in range(300)]
    rows += [rows[0], rows[1], (900, ">AAA", 1e9), (901, None, 5.0), (902, "JJ**", 5.0), (903, "WW", None), (904, "WW", float("nan")), (905, "WW", -3.0), (906, "YY", 1e6)]
    df = spark.createDataFrame(rows, "line_id bigint, seqs string, counts double").withColumn("seq", F.lit("q")).withColumn("reads", F.lit(0))
    got = {(r["kind"], r["seq"]): r["total"] for r in heavy_hitters.frequent_sequences(df, min_share=0.2).collect()}
    assert got == {("rows", "A"): 100.0, ("reads", "YY"): 1e6}
    top = heavy_hitters.top_sequences(df, 2).collect()
    assert [(r["seq"], r["n_rows"]) for r in top] == [("A", 100), ("AC", 40)]  # of equal counts the smaller
    assert heavy_hitters.frequent_sequences(df.limit(0)).count() == 0


def test_lines_without_id(spark):
    rows = [(None, "AA", 2.0), (None, "aa", 2.0), (None, "AA", 3.0), (None, "CC", 2.0), (None, "", 9.0), (7, "CC", 2.0), (7, "CC", 2.0)]
    df = spark.createDataFrame(rows, "line_id bigint, seqs string, counts double")
    top = heavy_hitters.top_sequences(df, 5).collect()
    assert [(r["seq"], r["n_rows"], r["n_reads"]) for r in top] == [("AA", 2, 5.0), ("CC", 2, 4.0)]


# ---- 3: linked groups --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,m,seed", [(1, 1, 0), (80, 60, 1), (80, 200, 2), (300, 290, 3)])
def test_boruvka_equals_union_find(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 3), (3, None)]
    got = {r["id"]: r["label"] for r in boruvka(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == union_find([(a, b) for a, b in pairs if a is not None and b is not None and a != b])


def test_boruvka_on_chains_and_hubs(spark):
    rng = random.Random(9)
    ids = rng.sample(range(10_000), 400)
    chain = list(zip(ids, ids[1:]))
    hub = [(20_000, 30_000 + i) for i in range(500)]
    got = {r["id"]: r["label"] for r in boruvka(spark.createDataFrame(chain + hub, "src bigint, dst bigint")).collect()}
    assert {got[i] for i in ids} == {min(ids)} and {got[30_000 + i] for i in range(500)} == {20_000}
    assert boruvka(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_linked_groups(spark):
    pairs = [(1, 2, 1, day(1)), (2, 1, 5, day(2)), (3, 4, 9, day(1)), (4, 3, 2, day(3)), (4, 3, None, day(9)), (5, 5, 0, day(1)), (6, 99, 1, day(1)), (7, None, 1, day(1)), (8, 9, 3, None), (8, 9, 2, None)]
    earlier = [(i, i, day(1)) for i in range(1, 10)] + [(10, 50, day(1)), (11, 50, day(1)), (11, 50, day(1)), (12, None, day(1)), (13, None, day(1)), (None, 50, day(1)), (4, 50, day(2))]
    a = spark.createDataFrame(pairs, "src bigint, dst bigint, dist int, measured_at timestamp").withColumn("lo", F.lit(1))
    b = spark.createDataFrame(earlier, "seq_id bigint, group_id bigint, loaded_at timestamp").withColumn("src", F.lit("x"))
    got = {tuple(r) for r in linked_groups.linked_groups(a, b).collect()}
    assert got == {(3, 3), (4, 3), (10, 3), (11, 3), (8, 8), (9, 8)}
    assert linked_groups.linked_groups(a.limit(0), b.limit(0)).count() == 0


# ---- 4: splits ---------------------------------------------------------------------------------------------------


def partition_rows(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, group_id bigint, donor_id string").withColumn("k", F.lit(0)).withColumn("weight", F.lit("w"))


def test_related_rows(spark):
    rows = [(1, 10, "dn-1"), (2, 10, None), (3, None, "DN1"), (4, 0, "n/a"), (5, -1, "N.A."), (6, 0, "Unknown"), (7, None, "?"), (8, 77, "none"), (None, 10, "DN1"), (2, 10, None)]
    got = {tuple(r) for r in grouped_splits.related_rows(grouped_splits.assign_splits(partition_rows(spark, rows))).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_splits_keep_blocks_and_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, rng.randrange(1, 400)]), f"D{rng.randrange(3000)}") for i in range(3000)]
    rows += [(10_000 + i, 5000, None) for i in range(1000)] + rows[:50]  # one block holds a quarter
    df = partition_rows(spark, rows)
    splits = grouped_splits.assign_splits(df, n_bins=50)
    got = splits.collect()
    assert sorted(r["row_id"] for r in got) == sorted({r[0] for r in rows})
    by_block = {}
    for r in got:
        by_block.setdefault(r["block_id"], set()).add(r["split"])
    assert all(len(s) == 1 and None not in s for s in by_block.values())
    report = {r["split"]: r for r in grouped_splits.split_report(splits).collect()}
    for split, share in grouped_splits.TARGETS.items():
        assert report[split]["actual_share"] == pytest.approx(share, abs=0.02)
    assert grouped_splits.assign_splits(df.limit(0)).count() == 0


def test_blocks_of_rows_with_several_groups(spark, monkeypatch):
    monkeypatch.setattr(grouped_splits, "DIFFERENCED_WEIGHTS", 3)  # several tasks balance
    rng = random.Random(11)
    rows = [(rng.randrange(700), rng.choice([None, rng.randrange(1, 300)]), rng.choice([None, f"D{rng.randrange(300)}"])) for _ in range(900)]
    keys = {}
    pairs = [(i, keys.setdefault(k, i)) for i, g, d in rows for k in (("g", g), ("d", d)) if k[1] is not None]
    want = union_find(pairs) | {}
    splits = grouped_splits.assign_splits(partition_rows(spark, rows), n_bins=20)
    got = splits.collect()
    assert {r["row_id"]: r["block_id"] for r in got} == {i: want.get(i, i) for i, _, _ in rows}
    check = grouped_splits.split_check(splits, tolerance=0.02).first()
    assert (check["n_rows"], check["n_repeated"], check["n_parted"], check["n_off"]) == (len({r[0] for r in rows}), 0, 0, 0)


def test_differencing_is_even():
    rng = np.random.default_rng(1)
    weights = [(int(w), int(n)) for w, n in zip(rng.choice(500, 60, replace=False) + 1, rng.integers(1, 10, 60))]
    vectors = [grouped_splits._of_weight(w, n, 10) for w, n in weights]
    bins = grouped_splits.differenced(vectors, 10)
    sums = np.zeros(10, int)
    for v, b in zip(vectors, bins):
        assert sorted(b) == list(range(10))
        sums[b] += v
    assert sums.sum() == sum(w * n for w, n in weights) and sums.max() - sums.min() <= 0.01 * sums.mean()


# ---- 5: overlap --------------------------------------------------------------------------------------------------


def test_overlap_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "SHARD_PASSAGES", 30)
    monkeypatch.setattr(split_overlap, "SCAN_ROWS", 40)
    monkeypatch.setattr(split_overlap, "HOT_PASSAGE", 5)
    monkeypatch.setattr(split_overlap, "FEW_SHARDS", 2)
    rng = random.Random(6)

    def mutate(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s))
            s[at : at + rng.choice([0, 1, 1, 2]) % 2] = rng.choice(["", "A", "W", "AW"][:3])
        return "".join(s)

    base = ["AR" + "".join(rng.choices("ACDW", k=rng.randrange(7, 16))) + "DY" for _ in range(25)]
    train = [(f"t{i}", mutate(rng.choice(base)), "s") for i in range(120)] + [("tn", None, "s"), ("te", "", None), ("long", "AC" * 5000, "s"), (None, base[0], "s")]
    test = [(f"e{i}", mutate(rng.choice(base)).lower(), "s", "valid") for i in range(60)] + [("en", None, None, None), ("el", "AC" * 5000, "s", "test"), ("e0x", base[0], None, "test")]
    t = spark.createDataFrame(train + train[:5], "id string, seq string, source string").withColumn("text", F.lit("x"))
    e = spark.createDataFrame(test + test[:5], "id string, seq string, source string, part_name string").withColumn("n", F.lit(0))
    ok = lambda i, s: i and s and len(s) >= 10
    want = {
        (min(a, b), max(a, b)) for (a, s, *_), (b, u, *_) in itertools.product(train, test)
        if ok(a, s) and ok(b, u) and abs(len(s) - len(u)) <= 2 and (s == u or len(s) < 100) and edits(s.upper(), u.upper()) <= 2
    }
    assert {tuple(r) for r in split_overlap.overlapping_pairs(t, e).collect()} == want
    cover = {r["id"]: r for r in split_overlap.coverage(t, e).collect()}
    assert cover["el"]["covered"] == 1.0 and all(0 < r["covered"] <= 1 for r in cover.values())
    report = split_overlap.overlap_report(t, e).collect()
    assert sum(r["n_pairs"] for r in report) == len(want) and sum(r["n_records"] for r in report) == len(test)
    assert split_overlap.overlapping_pairs(t.limit(0), e).count() == 0 and split_overlap.overlapping_pairs(t, e.limit(0)).count() == 0


# ---- 6: clusters -------------------------------------------------------------------------------------------------


def brute_clusters(rows, radius=4):
    last = {}
    for i, s, rho, delta, at in rows:
        if i is not None and (i not in last or (at, s.upper(), rho or -1, delta or -1) > last[i]):
            last[i] = (at, s.upper(), rho or -1, delta or -1)
    recs = {i: v[1] for i, v in last.items()}
    same = lambda i: [j for j in recs if len(recs[j]) == len(recs[i])]
    rho = {i: sum(misses(recs[i], recs[j]) < 4 for j in same(i)) if last[i][2] < 0 else last[i][2] for i in recs}
    delta = {}
    for i in recs:
        near = [d for j in same(i) if rho[j] > rho[i] and (d := misses(recs[i], recs[j])) <= 8]
        delta[i] = last[i][3] if last[i][3] >= 0 else min(near, default=len(recs[i]))
    able = [i for i in recs if rho[i] >= 6 and delta[i] >= 6]
    centres = [i for i in able if not any(j < i and len(recs[j]) == len(recs[i]) and misses(recs[i], recs[j]) <= 4 for j in able)]
    out = {}
    for i in recs:
        near = [(d, c) for c in centres if len(recs[c]) == len(recs[i]) and (d := misses(recs[i], recs[c])) <= radius]
        if near:
            out[i] = min(near)[1]
    return {i: (rho[i], delta[i]) for i in recs}, out, recs


def test_density_clusters(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(12):
        centre = rng.choices("ACGT", k=rng.choice([45, 70]))
        for _ in range(rng.randrange(2, 16)):
            s = list(centre)
            for _ in range(rng.randrange(6)):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
            text = "".join(s)
            rows.append((k, text.lower() if k % 3 == 0 else text, None, None, day(5)))
            rows += [rows[-1]] * (k % 2) + [(k, "A" * 45, 999, 1, day(1))] * (k % 5 == 0)
            k += 1
    rows += [(500 + i, rows[0][1], None, None, day(5)) for i in range(30)] + [(None, "ACGT", 1, 1, day(1))]
    feats, want, recs = brute_clusters(rows)
    df = spark.createDataFrame(rows, "seq_id bigint, seq string, rho bigint, delta int, loaded_at timestamp").withColumn("cell", F.lit("x")).withColumn("dist", F.lit(1))
    made = density_clusters.DensityClusters(df)
    assert {r["seq_id"]: (r["rho"], r["delta"]) for r in made.features.collect()} == feats
    assert {r["seq_id"]: r["centre_id"] for r in made.members().collect()} == want and want
    # the same by hand: clusters of each cell, joined where they share their core point, nearest first
    merged_cells = {}
    for r in made.local_clusters().collect():
        merged_cells.setdefault(r["centre_id"], {})[r["seq"]] = r["dist"]
    by_text = {s: min((c[s], k) for k, c in merged_cells.items() if s in c)[1] for s in set().union(*merged_cells.values())}
    assert {i: by_text[s] for i, s in recs.items() if s in by_text} == want
    for r in made.described().collect():
        members = [i for i, c in want.items() if c == r["centre_id"]]
        total = {i: sum(misses(recs[i], recs[j]) for j in members) for i in members}
        assert r["n_members"] == len(members) and r["medoid_id"] == min(members, key=lambda i: (total[i], i))
        assert r["mean_dist"] == pytest.approx(min(total.values()) / len(members))
    merged = {r["seq_id"]: r["cluster_id"] for r in made.merged().collect()}
    assert set(merged) == set(want) and all(merged[i] <= c for i, c in want.items())
    assert density_clusters.centred_clusters(df.limit(0)).count() == 0
