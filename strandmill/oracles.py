"""The queries in SQL for DuckDB, over the same whole tables."""

from __future__ import annotations

_READS = r"""
WITH lines AS (SELECT DISTINCT line_id, seqs FROM cluster_input WHERE seqs IS NOT NULL),
reads AS (SELECT line_id, seqs AS seq FROM lines WHERE NOT regexp_matches(seqs, '^\s*>'))
"""

_ROUNDS = """
WITH last AS (SELECT seq, arg_max({r1: r1, r2: r2, r3: r3}, loaded_at) AS x FROM enrichment WHERE seq IS NOT NULL GROUP BY seq),
rounds AS (
  SELECT seq, CASE WHEN x.r1 IS NULL OR isnan(x.r1) THEN 0.0 ELSE x.r1 + 0.0 END AS r1,
    CASE WHEN x.r2 IS NULL OR isnan(x.r2) THEN 0.0 ELSE x.r2 + 0.0 END AS r2,
    CASE WHEN x.r3 IS NULL OR isnan(x.r3) THEN 0.0 ELSE x.r3 + 0.0 END AS r3 FROM last
), kept AS (
  SELECT * FROM rounds WHERE NOT contains(seq, '*') AND length(seq) <= 20
    AND (r3 >= 3 OR r2 >= 3 OR r1 >= 3 OR (r1 >= 1 AND r2 >= 1 AND r3 >= 1))
), labelled AS (SELECT *, round(log10((r3 + 1) / (r2 + 1)), 6) AS ratio, CASE WHEN r3 - r2 > 1e-6 THEN 1 ELSE 0 END AS l FROM kept)
"""

_CLEAN = "regexp_replace(upper({}), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"

_SEEDS = f"""
rows_ AS (SELECT DISTINCT id, {_CLEAN.format("seq")} AS seq FROM (SELECT id, seq FROM knn_train UNION ALL SELECT id, seq FROM knn_test) WHERE id IS NOT NULL AND seq IS NOT NULL),
seeds AS (SELECT min(CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)) AS id, seq, count(*) AS count FROM rows_ WHERE seq <> '' GROUP BY seq)
"""

_PAIRS = """
, pairs AS (
  SELECT a.id AS src, b.id AS dst, levenshtein(a.seq, b.seq) AS dist FROM seeds a JOIN seeds b
  ON a.id < b.id AND abs(length(a.seq) - length(b.seq)) <= 2 AND levenshtein(a.seq, b.seq) <= 2
)
"""

_DNA = """
WITH last AS (SELECT seq_id, arg_max(seq, loaded_at) AS seq FROM cal_feat WHERE seq_id IS NOT NULL AND seq IS NOT NULL GROUP BY seq_id),
dna AS (SELECT min(seq_id) AS id, upper(seq) AS seq, count(*) AS n FROM last GROUP BY upper(seq))
"""

_DNA_PAIRS = """
, near AS (SELECT a.id AS src, b.id AS dst, hamming(a.seq, b.seq) AS dist, b.n AS n FROM dna a JOIN dna b ON length(a.seq) = length(b.seq) AND a.id <> b.id AND hamming(a.seq, b.seq) <= 3)
, best AS (
  SELECT dna.id, dna.seq, dna.n, coalesce(max(near.n) FILTER (dist = 1), 0) AS m1, coalesce(max(near.n) FILTER (dist = 2), 0) AS m2, coalesce(max(near.n) FILTER (dist = 3), 0) AS m3
  FROM dna LEFT JOIN near ON near.src = dna.id GROUP BY ALL
)
"""


def _tail(m: str, n: str = "n", size: str = "length(seq)", k: int = 1) -> str:
    """Binomial tail summed upwards from n; the terms vanish long before 60."""
    p = f"(pow(0.001, {k}) * pow(0.999, {size} - {k}))"
    t = f"({n} + {m})"
    term = f"exp(lgamma({t} + 1) - lgamma(i + 1) - lgamma({t} - i + 1) + i * ln({p}) + ({t} - i) * ln(1 - {p}))"
    return f"(CASE WHEN {m} = 0 THEN 0.0 ELSE list_sum(list_transform(range(CAST({n} AS BIGINT), CAST(least({t}, {n} + 60) AS BIGINT) + 1), lambda i: {term})) END)"


_FEATURES = """
, rho AS (SELECT id, seq, length(seq) AS n, (SELECT count(*) FROM dna p WHERE length(p.seq) = length(dna.seq) AND hamming(p.seq, dna.seq) < 4) AS rho FROM dna)
, feat AS (
  SELECT a.id, a.seq, a.n, a.rho, coalesce(min(hamming(a.seq, b.seq)) FILTER (b.rho > a.rho), max(hamming(a.seq, b.seq))) AS delta
  FROM rho a JOIN rho b ON a.n = b.n GROUP BY ALL
)
"""


def _peptides(name: str, table: str, extra: str = "") -> str:
    return f"{name} AS (SELECT DISTINCT id, {_CLEAN.format('seq')} AS seq{extra} FROM {table} WHERE id IS NOT NULL AND seq IS NOT NULL AND {_CLEAN.format('seq')} <> '')"


_ASKED = "WITH " + _peptides("train", "knn_train") + ", " + _peptides("test_", "knn_test") + r", asked AS (SELECT * FROM test_ WHERE CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT) % 100 = 0)"

_NEAREST = """
, ranked AS (
  SELECT a.id, a.seq, t.seq AS closest_target, {dist} AS mindist, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, t.id) AS r FROM asked a, train t
) SELECT id, seq, closest_target, mindist FROM ranked WHERE r = 1"""

_LONG = "CASE WHEN length(a.seq) >= length(t.seq) THEN a.seq ELSE t.seq END"
_SHORT = "CASE WHEN length(a.seq) >= length(t.seq) THEN t.seq ELSE a.seq END"
_SHIFT = f"list_min(list_transform(range(0, abs(length(a.seq) - length(t.seq)) + 1), lambda i: levenshtein(substr({_LONG}, CAST(i AS BIGINT) + 1, least(length(a.seq), length(t.seq))), {_SHORT})))"

_COMPONENTS = """
, sides AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links)
, reach AS (
  SELECT DISTINCT a AS id, a AS label FROM sides
  UNION
  SELECT sides.b, reach.label FROM reach JOIN sides ON sides.a = reach.id WHERE reach.label < sides.b
), labels AS (SELECT id, min(label) AS label FROM reach GROUP BY id)
, groups AS (
  SELECT s.id, coalesce(top.id, s.id) AS "group" FROM ranked s LEFT JOIN labels ON labels.id = s.rank LEFT JOIN ranked top ON top.rank = labels.label
)
"""


def _clusters(n: int) -> str:
    return (
        "WITH RECURSIVE "
        + _SEEDS
        + _PAIRS
        + f""", ranked AS (SELECT id, seq, count, row_number() OVER (ORDER BY count DESC, id) AS rank FROM seeds QUALIFY rank <= {n})
, links AS (SELECT a.rank AS src, b.rank AS dst FROM pairs JOIN ranked a ON a.id = pairs.src JOIN ranked b ON b.id = pairs.dst)"""
        + _COMPONENTS
    )


def _codons() -> str:
    from strandmill.functions.sequence import CODON_BASES, CODON_RESIDUES

    codons = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    return "MAP {" + ", ".join(f"'{c}': '{r}'" for c, r in zip(codons, CODON_RESIDUES)) + "}"


def _translated(seq: str) -> str:
    return f"list_reduce(list_transform(range(0, length({seq}) // 3), lambda i: coalesce({_codons()}[substr({seq}, CAST(i AS BIGINT) * 3 + 1, 3)], 'X')), lambda x, y: x || y)"



_RULES = [
    "CAST(length(seq) % 2 = 0 AS INT)", "CAST(length(seq) > 14 AS INT)", "CAST(starts_with(seq, 'AR') AS INT)",
    "CAST(ends_with(seq, 'DY') AS INT)", "CAST(contains(seq, 'W') AS INT)", "CAST(length(seq) % 3 = 0 AS INT)",
]


def _majority(*which: int) -> str:
    return f"CASE WHEN ({' + '.join(_RULES[i] for i in which)}) * 2 > {len(which)} THEN 1 ELSE 0 END"


def _component() -> str:
    from strandmill.registry import MEANS, WEIGHTS

    score = [f"(ln({w}) + r3 * ln({m}) - {m})" for m, w in zip(MEANS, WEIGHTS)]
    best = f"greatest({', '.join(score)})"
    clean = " ".join(f"WHEN {s} = {best} THEN {'0.0' if m == min(MEANS) else f'greatest(round_even(r3 - {m}, 0), 0.0)'}" for s, m in zip(score, MEANS))
    return f"CASE {clean} END"


def _files() -> dict[str, str]:
    """Of the queries that go through files (strandmill/file_queries.py)."""
    from strandmill.operators.parsing import HEAD, TAILS

    train, test_ = _peptides("train", "knn_train"), _peptides("test_", "knn_test")
    full = _peptides("full_", "knn_train", ", coalesce(target_num, 0) AS target")
    tail = lambda n: f"CASE WHEN {n} % 2 = 0 THEN substr('{TAILS['tail_seq1_DY']}', 1, 6) ELSE substr('{TAILS['tail_seq2_DV']}', 1, 6) END"
    last = "WITH last AS (SELECT seq_id, upper(arg_max(seq, loaded_at)) AS seq FROM cal_feat WHERE seq_id IS NOT NULL AND seq IS NOT NULL GROUP BY seq_id)"
    return {
        "q43_fastq_round_trip": _DNA + "SELECT 'run_' || id || '_' || n AS read_id, seq, repeat('I', length(seq)) AS qual FROM dna",
        "q44_fasta_round_trip": f"WITH {train} SELECT id AS read_id, seq FROM train",
        "q45_cdrs_from_hits": _DNA + f", cut AS (SELECT id AS read_id, seq || {tail('id')} AS cdr FROM dna) SELECT read_id, cdr, {_translated('cdr')} AS peptide FROM cut WHERE length(cdr) % 3 = 0 AND length(cdr) > 6",
        "q46_flagship": last
        + f""", cut AS (SELECT seq_id, seq || {tail('seq_id')} AS cdr FROM last)
, found AS (SELECT seq_id % 3 AS r, {_translated('cdr')} AS seq FROM cut WHERE length(cdr) % 3 = 0 AND length(cdr) > 6)
, merged AS (SELECT seq, CAST(count(*) FILTER (r = 0) AS DOUBLE) AS r1, CAST(count(*) FILTER (r = 1) AS DOUBLE) AS r2, CAST(count(*) FILTER (r = 2) AS DOUBLE) AS r3 FROM found GROUP BY seq)
, kept AS (SELECT * FROM merged WHERE NOT contains(seq, '*') AND length(seq) <= 20 AND (r3 >= 3 OR r2 >= 3 OR r1 >= 3 OR (r1 >= 1 AND r2 >= 1 AND r3 >= 1)))
SELECT seq, r1, r2, r3, round(log10((r3 + 1) / (r2 + 1)), 6) AS ratio, CASE WHEN r3 - r2 > 1e-6 THEN 1 ELSE 0 END AS l, CASE WHEN r3 - r2 > 1e-6 THEN 0 ELSE 1 END AS l2 FROM kept""",
        "q47_aligned_targets": f"WITH {full} SELECT row_number() OVER (ORDER BY id, seq) - 1 AS row_idx, seq, target FROM full_ WHERE NOT isnan(target)",
        "q48_text_columns": _ROUNDS + "SELECT seq, r1, r2, r3 FROM rounds",
        "q50_sample_files": _READS
        + "SELECT 's' || (coalesce(line_id, 0) % 4) AS sample, trim(seq, ' ') AS seq, count(*) AS n FROM reads WHERE trim(seq, ' ') <> '' AND NOT contains(seq, chr(10)) AND NOT contains(seq, chr(13)) GROUP BY ALL",
        "q51_cluster_files": _clusters(100_000)
        + """, sized AS (SELECT s.id, s.seq, s.count, g."group", CAST(count(*) OVER (PARTITION BY g."group") AS INT) AS group_size FROM seeds s JOIN groups g ON g.id = s.id)
SELECT *, CASE WHEN group_size > 1 THEN 'shared' ELSE 'single' END AS part FROM sized""",
        "q52_primer_check": _DNA
        + f", p AS (SELECT id, CASE WHEN length(seq) >= {len(HEAD)} THEN CAST(hamming(substr(rpad(seq, {len(HEAD)}, '-'), 1, {len(HEAD)}), '{HEAD}') AS INT) END AS misses FROM dna) SELECT id, misses, coalesce(misses <= 6, false) AS matches FROM p",
        "q53_strip_and_share": _READS + "SELECT DISTINCT bare, round(hamming(bare, reverse(bare)) / length(bare), 6) AS share FROM (SELECT trim(seq, 'J*- ') AS bare FROM reads) WHERE bare <> ''",
        "q54_similarity_file": _ASKED
        + _NEAREST.format(dist="levenshtein(a.seq, t.seq)").replace(") SELECT id, seq, closest_target, mindist FROM ranked WHERE r = 1", ") SELECT row_number() OVER (ORDER BY mindist, id) - 1 AS place, id, closest_target, CAST(mindist AS INT) AS mindist FROM ranked WHERE r = 1"),
        "q55_denoise_stats": _ROUNDS + f"SELECT count(*) FILTER (r3 <> 0) AS nonzero_before, count(*) FILTER (clean <> 0) AS nonzero_after FROM (SELECT r3, {_component()} AS clean FROM rounds)",
        "q56_paired_distances": f"WITH {train}, {test_}"
        + """, a AS (SELECT seq, row_number() OVER (ORDER BY id) - 1 AS r FROM test_), b AS (SELECT seq, row_number() OVER (ORDER BY id) - 1 AS r FROM train)
SELECT CAST(length(a.seq) AS INT) AS length, CAST(levenshtein(a.seq, b.seq) AS INT) AS dist, count(*) AS n FROM a JOIN b ON b.r = a.r % (SELECT count(*) FROM b) GROUP BY ALL""",
        "q57_equality_probe": "WITH " + _SEEDS + "SELECT id, seq FROM seeds WHERE seq = (SELECT min(seq) FROM seeds)",
    }


def oracle_sql() -> dict[str, str]:
    from strandmill.operators.parsing import HEAD, TAILS

    pad = "CASE WHEN length(seq) <= 20 THEN repeat('J', (20 - length(seq)) // 2) || seq || repeat('J', (20 - length(seq)) - (20 - length(seq)) // 2) ELSE seq {} END"
    train = "WITH " + _peptides("train", "knn_train")
    read = f"'CCATGG' || CASE WHEN id % 3 = 0 THEN '{HEAD[:2]}A{HEAD[3:]}' ELSE '{HEAD}' END || seq || CASE WHEN id % 2 = 0 THEN '{TAILS['tail_seq1_DY']}' ELSE '{TAILS['tail_seq2_DV']}' END || 'CC'"
    p1, p2, p3 = (_tail(f"m{k}", k=k) for k in (1, 2, 3))
    any_way = lambda k: f"(CASE WHEN m{k} = 0 THEN 0.0 ELSE 1 - pow(1 - least({_tail(f'm{k}', k=k)}, 1.0), round(exp(lgamma(length(seq) + 1) - lgamma({k + 1}) - lgamma(length(seq) - {k} + 1)))) END)"

    def replicate(parity: int, name: str) -> str:
        base = f"d{name} AS (SELECT min(seq_id) AS id, upper(seq) AS seq, count(*) AS n FROM last WHERE seq_id % 2 = {parity} GROUP BY upper(seq))"
        near = _DNA_PAIRS.replace("dna", f"d{name}").replace("near", f"near{name}").replace("best", f"best{name}")
        return base + near + f", p{name} AS (SELECT seq, greatest({p1}, {p2}, {p3}) AS p FROM best{name})"

    out = {
        "q01_read_counts": _READS + "SELECT trim(seq, ' ') AS seq, count(*) AS n FROM reads GROUP BY 1",
        "q01_line_counts": _READS + "SELECT trim(seqs, ' ') AS seq, count(*) AS n FROM lines GROUP BY 1",
        "q01_distinct_sequences": _READS + "SELECT DISTINCT trim(seq, ' ') AS seq FROM reads",
        "q02_round_counts_long": _ROUNDS + "SELECT seq, round, n FROM (UNPIVOT rounds ON r1, r2, r3 INTO NAME round VALUE n) WHERE n <> 0",
        "q03_enrichment_outer": _ROUNDS + "SELECT seq, r1, r2, r3 FROM rounds WHERE r1 <> 0 OR r2 <> 0 OR r3 <> 0",
        "q04_enrichment_ratio": _ROUNDS + "SELECT seq, round(log10((r3 + 1) / (r2 + 1)), 6) AS ratio FROM rounds",
        "q05_support_filter": _ROUNDS + "SELECT seq, r1, r2, r3 FROM kept",
        "q06_class_labels": _ROUNDS + "SELECT seq, r1, r2, r3, ratio, l, 1 - l AS l2 FROM labelled",
        "q07_label_balance": _ROUNDS + "SELECT l, length(seq) AS len, count(*) AS n FROM labelled GROUP BY ALL",
        "q08_events_rounds": """
WITH e AS (SELECT user_id AS seq, least((dayofyear(ts) - 1) // 7, 3) AS w FROM events WHERE user_id IS NOT NULL)
SELECT seq, CAST(count(*) FILTER (w = 0) AS DOUBLE) AS w0, CAST(count(*) FILTER (w = 1) AS DOUBLE) AS w1,
  CAST(count(*) FILTER (w = 2) AS DOUBLE) AS w2, CAST(count(*) FILTER (w = 3) AS DOUBLE) AS w3 FROM e GROUP BY seq""",
        "q29_positive_in_either_round": _ROUNDS + "SELECT seq, r1, r2, r3 FROM rounds WHERE r1 <> 0 OR r2 <> 0",
        "q09_centre_pad": train
        + f" SELECT id, {pad.format('')} AS padded, {pad.format('|| CASE WHEN length(seq) % 2 = 1 THEN chr(74) ELSE chr(0) END').replace('chr(74)', chr(39) + 'J' + chr(39)).replace('chr(0)', chr(39) * 2)} AS padded_as_reference,"
        + " replace(seq, 'J', '') || repeat('J', greatest(20 - length(replace(seq, 'J', '')), 0)) AS right_padded FROM train",
        "q10_one_hot_sum": train
        + """ SELECT id, CAST(length(seq) AS INT) AS residues, width, low, high,
  CAST(strpos('ACDEFGHIKLMNPQRSTVWY', least_) - 1 AS INT) * CAST(greatest(40, length(seq)) AS INT) + strpos(seq, least_) - 1 + greatest(40 - length(seq), 0) // 2 AS first_place
FROM (SELECT *, CAST(20 * greatest(40, length(seq)) AS INT) AS width, 40 - CAST(floor((40 - length(seq)) / 2) AS INT) - 20 AS low, 40 - length(seq) - CAST(floor((40 - length(seq)) / 2) AS INT) AS high,
  list_min(list_transform(range(1, length(seq) + 1), lambda i: substr(seq, CAST(i AS BIGINT), 1))) AS least_ FROM train)""",
        "q11_translate_codons": _DNA + f"SELECT id, {_translated('seq')} AS peptide FROM dna WHERE length(seq) % 3 = 0 AND length(seq) > 6",
        "q12_kmer_counts": train
        + """, w AS (SELECT DISTINCT id, seq, substr(seq, CAST(i AS BIGINT), 3) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - 1)) AS i FROM train WHERE length(seq) >= 3))
SELECT id, kmer, CAST((length(seq) - length(replace(seq, kmer, ''))) // 3 AS INT) AS n FROM w""",
        "q13_lev_neighbors": "WITH " + _SEEDS + _PAIRS + "SELECT src, dst, dist FROM pairs",
        "q14_hamming_neighbors": _DNA + "SELECT a.id AS src, b.id AS dst, hamming(a.seq, b.seq) AS dist FROM dna a JOIN dna b ON a.id < b.id AND length(a.seq) = length(b.seq) AND hamming(a.seq, b.seq) <= 3",
        "q15_nearest_match": _ASKED + _NEAREST.format(dist="levenshtein(a.seq, t.seq)"),
        "q16_nearest_match_shift": _ASKED + _NEAREST.format(dist=_SHIFT),
        "q17_one_to_all": "WITH " + _SEEDS + "SELECT id, levenshtein(seq, 'ARDYYGSGSYYFDY') AS dist FROM seeds",
        "q18_rho_delta": _DNA + _FEATURES + "SELECT id, rho, delta FROM feat",
        "q19_density_assign": _DNA
        + _FEATURES
        + """, c AS (SELECT * FROM feat WHERE rho > 5 AND delta > 5)
, r AS (SELECT f.id, c.id AS centre, row_number() OVER (PARTITION BY f.id ORDER BY hamming(f.seq, c.seq), c.id) AS r FROM feat f JOIN c ON c.n = f.n)
SELECT r.id, coalesce(own.id, r.centre) AS centre_id FROM r LEFT JOIN c own ON own.id = r.id WHERE r = 1""",
        "q20_max_neighbor_count": _DNA + _DNA_PAIRS + "SELECT id, n, m1 AS max_neighbor_cnt_d1, m2 AS max_neighbor_cnt_d2, m3 AS max_neighbor_cnt_d3 FROM best",
        "q21_noise_probability": _DNA + _DNA_PAIRS + f"SELECT id, round({p1}, 6) AS p1, round({p2}, 6) AS p2, round({p3}, 6) AS p3, round(greatest({p1}, {p2}, {p3}), 6) AS p_max FROM best",
        "q22_noise_centers": _DNA
        + _DNA_PAIRS
        + f", p AS (SELECT id, greatest({any_way(1)}, {any_way(2)}, {any_way(3)}) AS p_max FROM best) SELECT id, round(p_max, 6) AS p_max FROM p WHERE p_max < 0.05 / (SELECT count(DISTINCT upper(seq)) FROM last)",
        "q23_replicate_accept": _DNA.split(",\ndna")[0]
        + ", "
        + replicate(1, "x")
        + ", "
        + replicate(0, "y")
        + """, both_ AS (SELECT coalesce(px.seq, py.seq) AS seq, coalesce(px.p, 1.0) AS p1, coalesce(py.p, 1.0) AS p2 FROM px FULL JOIN py ON px.seq = py.seq)
SELECT seq, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p1 * p2, 6) AS p FROM both_ WHERE p1 * p2 <= 0.05 / (SELECT count(*) FROM both_)""",
        "q24_components": _clusters(100_000) + 'SELECT id, "group" FROM groups',
        "q25_nonseed_projection": _clusters(1_000)
        + """, rest AS (SELECT id FROM seeds WHERE id NOT IN (SELECT id FROM ranked))
, hits AS (SELECT src AS id, dst AS seed FROM pairs UNION ALL SELECT dst, src FROM pairs)
, votes AS (SELECT rest.id, g."group", count(*) AS n FROM rest JOIN hits ON hits.id = rest.id JOIN groups g ON g.id = hits.seed GROUP BY ALL)
, won AS (SELECT id, "group" FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, "group") = 1)
SELECT rest.id, coalesce(won."group", rest.id) AS "group" FROM rest LEFT JOIN won ON won.id = rest.id""",
        "q26_clusters_output": _clusters(100_000) + 'SELECT s.id, s.seq, s.count, g."group", CAST(count(*) OVER (PARTITION BY g."group") AS INT) AS group_size FROM seeds s JOIN groups g ON g.id = s.id',
        "q27_topn_seeds": "WITH " + _SEEDS + "SELECT id, seq, CAST(row_number() OVER (ORDER BY count DESC, id) AS INT) AS rank FROM seeds QUALIFY rank <= 1000",
        "q28_partition_check": """
WITH total AS (SELECT count(DISTINCT row_id) AS n FROM cluster_partition)
SELECT 'train' AS part, CAST(floor(n * 0.8) AS BIGINT) AS target, true AS within, CAST(0 AS BIGINT) AS n_parted FROM total
UNION ALL SELECT 'valid', CAST(floor(n * 0.1) AS BIGINT), true, CAST(0 AS BIGINT) FROM total
UNION ALL SELECT 'test', CAST(n - floor(n * 0.8) - floor(n * 0.1) AS BIGINT), true, CAST(0 AS BIGINT) FROM total""",
        "q38_kmer_totals": train
        + """, w AS (SELECT DISTINCT id, seq, substr(seq, CAST(i AS BIGINT), 3) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - 1)) AS i FROM train WHERE length(seq) >= 3))
SELECT kmer, CAST(sum((length(seq) - length(replace(seq, kmer, ''))) // 3) AS BIGINT) AS n FROM w GROUP BY kmer""",
        "q30_count_denoise": _ROUNDS + f"SELECT seq, r3, {_component()} AS clean FROM rounds",
        "q37_collision_bound": "WITH "
        + _SEEDS
        + """, by_ AS (SELECT CAST(length(seq) AS INT) AS len, count(*) AS n, pow(20.0, length(seq)) AS whole FROM seeds GROUP BY length(seq))
, x AS (SELECT *, list_sum(list_transform([0, 1, 2], lambda k: exp(lgamma(len + 1) - lgamma(k + 1) - lgamma(len - least(k, len) + 1)) * pow(1 / 20.0, len - k) * pow(19 / 20.0, k))) AS near,
    list_sum(list_transform(range(0, n), lambda i: CASE WHEN i < whole THEN ln(1 - i / whole) ELSE 0 END)) AS distinct_ FROM by_)
SELECT len, n, round(CASE WHEN n < 2 THEN 0 WHEN len <= 2 OR n > whole THEN 1 ELSE 1 - exp(n * (n - 1) / 2.0 * ln(1 - near) - distinct_) END, 6) AS bound FROM x""",
        "q34_ensemble_vote": train
        + f", v AS (SELECT id, {_majority(0, 1, 2, 3, 4, 5)} AS vote, {_majority(0, 2, 4)} AS two, {_majority(1, 3, 5)} AS three FROM train) SELECT id, vote, CASE WHEN vote + two + three > 0 THEN 'Non-specific' ELSE 'Anti-id (specific)' END AS call FROM v",
        "q35_knn_regression": _ASKED.replace("WITH ", "WITH " + _peptides("full_", "knn_train", ", target_num AS target") + ", ", 1)
        + """, q AS (SELECT id, seq || repeat('J', greatest(20 - length(seq), 0)) AS s FROM asked)
, t AS (SELECT id, target, seq || repeat('J', greatest(20 - length(seq), 0)) AS s FROM full_ WHERE target IS NOT NULL AND NOT isnan(target))
, r AS (SELECT q.id, t.target FROM q JOIN t ON length(q.s) = length(t.s) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY hamming(q.s, t.s), t.id) <= 5)
SELECT id, round(avg(target), 6) AS prediction FROM r GROUP BY id""",
        "q36_primer_locate_cdr": _DNA
        + f""", made AS (SELECT id AS read_id, {read} AS read_, seq, CASE WHEN id % 2 = 0 THEN substr('{TAILS['tail_seq1_DY']}', 1, 6) ELSE substr('{TAILS['tail_seq2_DV']}', 1, 6) END AS ending FROM dna)
, cut AS (SELECT read_id, seq || ending AS cdr FROM made)
SELECT read_id, cdr, {_translated('cdr')} AS peptide FROM cut WHERE length(cdr) % 3 = 0 AND length(cdr) > 6""",
        "q41_sql_functions": train
        + f" SELECT id, {pad.format('')} AS padded, CAST(hamming(seq, reverse(seq)) AS INT) AS turned, CAST({_SHIFT.replace('a.seq', 'seq').replace('t.seq', chr(39) + 'ARDY' + chr(39))} AS INT) AS shifted FROM train",
        "q40_ratio_auc": _ROUNDS
        + """, s AS (SELECT l, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM (SELECT l, log10((r2 + 1) / (r1 + 1)) AS x FROM labelled))
SELECT round((sum(r) FILTER (l = 1) - count(*) FILTER (l = 1) * (count(*) FILTER (l = 1) + 1) / 2.0) / (count(*) FILTER (l = 1) * count(*) FILTER (l = 0)), 6) AS auc FROM s""",
    }
    return out | _files() | {"q49_replicate_files": out["q23_replicate_accept"]}
