"""The same results in SQL for DuckDB, where SQL can state them over whole tables."""

from __future__ import annotations

_RECORDS = """
WITH last AS (
  SELECT seq, arg_max({{r1: r1, r2: r2, r3: r3}}, loaded_at) AS r FROM enrichment WHERE seq IS NOT NULL GROUP BY seq
), vals AS (
  SELECT seq, unnest([r.r1, r.r2, r.r3]) AS v FROM last
), terms AS (
  SELECT CAST(v AS BIGINT) AS term, count(*) AS n_occurrences, count(DISTINCT seq) AS n_records
  FROM vals WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1
), total AS (SELECT count(*) AS n FROM last)
{select}
"""

_LINES = """
WITH lines AS (
  SELECT DISTINCT line_id, regexp_replace(upper(seqs), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq,
    CASE WHEN NOT isnan(counts) AND NOT isinf(counts) AND counts > 0 THEN counts ELSE 0 END AS reads
  FROM cluster_input WHERE seqs IS NOT NULL AND NOT regexp_matches(seqs, '^\\s*>')
), totals AS (
  SELECT seq, count(*) AS n_rows, sum(reads) AS n_reads FROM lines WHERE seq <> '' GROUP BY seq
), whole AS (SELECT sum(n_rows) AS w_rows, sum(n_reads) AS w_reads FROM totals)
"""

_COMPONENTS = """
, sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS id, a AS label FROM sides
  UNION
  SELECT sides.b, reach.label FROM reach JOIN sides ON sides.a = reach.id WHERE reach.label < sides.b
), labels AS (SELECT id, min(label) AS label FROM reach GROUP BY id)
"""

_BLOCKS = (
    r"""
WITH RECURSIVE keyed AS (
  SELECT DISTINCT row_id, CASE WHEN group_id > 0 THEN group_id END AS g, regexp_replace(upper(donor_id), '[^A-Z0-9]', '', 'g') AS d
  FROM cluster_partition WHERE row_id IS NOT NULL
), links AS (
  SELECT row_id AS a, min(row_id) OVER (PARTITION BY g) AS b FROM keyed WHERE g IS NOT NULL
  UNION
  SELECT row_id, min(row_id) OVER (PARTITION BY d) FROM keyed WHERE d IS NOT NULL AND d NOT IN ('', 'NA', 'UNKNOWN', 'NONE')
)
"""
    + _COMPONENTS.replace("FROM links UNION SELECT b, a FROM links", "FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b")
)

_NEAR = """
WITH t AS (
  SELECT DISTINCT id, regexp_replace(upper(seq), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM knn_train WHERE id IS NOT NULL AND seq IS NOT NULL
), e AS (
  SELECT DISTINCT id, part_name, source, regexp_replace(upper(seq), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM knn_test WHERE id IS NOT NULL AND seq IS NOT NULL
), pairs AS (
  SELECT DISTINCT t.id AS a, e.id AS b, e.part_name, e.source, t.s AS ts, e.s AS es FROM t JOIN e
  ON length(t.s) >= 10 AND length(e.s) >= 10 AND abs(length(t.s) - length(e.s)) <= 2 AND levenshtein(t.s, e.s) <= 2
)
"""

#: Parts of the evaluation sequences that stand where an alignment with at most two edits allows it.
_COVERED = (
    _NEAR
    + """
, spots AS (
  SELECT es, ts, k, CAST(floor(length(es) * k / 3) AS INTEGER) AS start, CAST(floor(length(es) * (k + 1) / 3) AS INTEGER) AS stop
  FROM (SELECT DISTINCT es, ts FROM pairs), (SELECT unnest([0, 1, 2]) AS k)
), hits AS (
  SELECT DISTINCT es, start, stop FROM spots, (SELECT unnest([-2, -1, 0, 1, 2]) AS moved)
  WHERE abs(moved) <= k AND abs(moved - (length(ts) - length(es))) <= 2 - k AND start + moved >= 0
    AND substr(ts, start + moved + 1, stop - start) = substr(es, start + 1, stop - start)
), shares AS (SELECT es, sum(stop - start) / length(es) AS covered FROM hits GROUP BY es),
cover AS (
  SELECT b AS id, part_name, source, count(*) AS n_train, covered FROM pairs JOIN shares ON shares.es = pairs.es GROUP BY b, part_name, source, pairs.es, covered
)
"""
)

_DENSE = """
WITH last AS (
  SELECT seq_id, x.seq AS seq, x.rho AS rho, x.delta AS delta, length(x.seq) AS n FROM (
    SELECT seq_id, arg_max({seq: upper(seq), rho: rho, delta: delta}, loaded_at) AS x FROM cal_feat WHERE seq IS NOT NULL GROUP BY seq_id)
), dense AS (
  SELECT seq_id, seq, n, delta,
    coalesce(rho, (SELECT count(*) FROM last p WHERE p.n = last.n AND hamming(p.seq, last.seq) < 4)) AS rho FROM last
), feat AS (
  SELECT seq_id, seq, n, rho, coalesce(delta,
    (SELECT min(hamming(p.seq, dense.seq)) FROM dense p WHERE p.n = dense.n AND p.rho > dense.rho AND hamming(p.seq, dense.seq) <= 8), n) AS delta
  FROM dense
), able AS (SELECT * FROM feat WHERE rho >= 6 AND delta >= 6),
centres AS (
  SELECT * FROM able WHERE NOT EXISTS (SELECT 1 FROM able p WHERE p.n = able.n AND p.seq_id < able.seq_id AND hamming(p.seq, able.seq) <= 4)
), ranked AS (
  SELECT f.seq_id, c.seq_id AS centre_id, row_number() OVER (PARTITION BY f.seq_id ORDER BY hamming(f.seq, c.seq), c.seq_id) AS r
  FROM feat f JOIN centres c ON c.n = f.n AND hamming(f.seq, c.seq) <= 4
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _RECORDS.format(
            select="""
SELECT term, 'rare' AS flag FROM terms WHERE n_records < 3
UNION ALL SELECT term, 'common' FROM terms, total WHERE n_records > n * 0.1"""
        ),
        "p1_term_counts": _RECORDS.format(select="SELECT term, n_occurrences, n_records, n_records < 3 AS is_rare, n_records > n * 0.1 AS is_common FROM terms, total"),
        "p2_found": _LINES
        + """
SELECT 'rows' AS kind, seq FROM totals, whole WHERE n_rows >= 0.002 * w_rows
UNION ALL SELECT 'reads', seq FROM totals, whole WHERE n_reads > 0 AND n_reads >= 0.002 * w_reads""",
        "p2_top_sequences": _LINES + "SELECT seq, n_rows, n_reads FROM totals ORDER BY n_rows DESC, seq LIMIT 100",
        "p3_found": """
WITH RECURSIVE known AS (SELECT DISTINCT seq_id, group_id FROM helper_seq2group WHERE seq_id IS NOT NULL),
near AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(dist, (measured_at, -dist)) AS d FROM helper_nb
  WHERE src IS NOT NULL AND dst IS NOT NULL AND dist IS NOT NULL AND src <> dst GROUP BY 1, 2
), links AS (
  SELECT a, b FROM near WHERE d <= 2 AND a IN (SELECT seq_id FROM known) AND b IN (SELECT seq_id FROM known)
  UNION
  SELECT * FROM (SELECT seq_id AS a, min(seq_id) OVER (PARTITION BY group_id) AS b FROM known WHERE group_id IS NOT NULL) WHERE a <> b
)"""
        + _COMPONENTS
        + "SELECT id AS seq_id, label AS group_id FROM labels",
        "p4_found": _BLOCKS + "SELECT id AS row_id, label AS block_id FROM labels",
        "p4_split_check": "SELECT count(DISTINCT row_id) AS n_rows, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_parted, CAST(0 AS BIGINT) AS n_off FROM cluster_partition",
        "p5_found": _NEAR + "SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM pairs",
        "p5_coverage": _COVERED + "SELECT id, part_name, source, n_train, covered FROM cover",
        "p5_overlap_report": _COVERED
        + """, records AS (SELECT DISTINCT id, part_name, source FROM knn_test WHERE id IS NOT NULL),
found AS (SELECT id, part_name, source, sum(n_train) AS n_train, max(covered) AS covered FROM cover GROUP BY ALL)
SELECT r.part_name, r.source, count(*) AS n_records, count(f.id) AS n_overlapping, CAST(coalesce(sum(f.n_train), 0) AS BIGINT) AS n_pairs,
  round(coalesce(avg(f.covered), 0), 6) AS mean_covered
FROM records r LEFT JOIN found f ON f.id = r.id AND f.part_name IS NOT DISTINCT FROM r.part_name AND f.source IS NOT DISTINCT FROM r.source GROUP BY r.part_name, r.source""",
        "p6_found": _DENSE + "SELECT seq_id, centre_id FROM ranked WHERE r = 1",
        "p6_clusters": _DENSE
        + """, m AS (SELECT r.seq_id, r.centre_id, f.seq, f.n FROM ranked r JOIN feat f ON f.seq_id = r.seq_id WHERE r.r = 1)
, t AS (SELECT a.centre_id, a.seq_id, a.n, sum(hamming(a.seq, b.seq)) AS total, count(*) AS n_members FROM m a JOIN m b ON a.centre_id = b.centre_id GROUP BY ALL)
SELECT centre_id, n AS seq_len, n_members, seq_id AS medoid_id, round(total / n_members, 6) AS mean_dist FROM t QUALIFY row_number() OVER (PARTITION BY centre_id ORDER BY total, seq_id) = 1""",
        "p6_merged": _DENSE.replace("WITH last", "WITH RECURSIVE last", 1)
        + """, shared AS (SELECT f.seq, c.seq_id AS centre_id FROM feat f JOIN centres c ON c.n = f.n AND hamming(f.seq, c.seq) <= 4 WHERE f.rho >= 6),
links AS (SELECT DISTINCT a, b FROM (SELECT centre_id AS a, min(centre_id) OVER (PARTITION BY seq) AS b FROM shared) WHERE a <> b)"""
        + _COMPONENTS
        + "SELECT seq_id, coalesce(label, centre_id) AS cluster_id FROM ranked LEFT JOIN labels ON labels.id = centre_id WHERE r = 1",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_check": "SELECT DISTINCT replace(lower(trim(source)), '_', '-') AS source, true AS capped, true AS within FROM mix_targets WHERE source IS NOT NULL",
        "p6_features": _DENSE + "SELECT seq_id, rho, CAST(delta AS INTEGER) AS delta FROM feat",
    }
