"""Shared pieces of the equivalent SQL, for an engine with the same tables as views."""

PURCHASES = """
purchases AS (
  SELECT o_custkey AS cell_id, p_brand AS atse_id, concat(p_brand, '|', p_type) AS junction_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS factor_idx,
         CAST(year(o_orderdate) AS INTEGER) AS sample
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

COUNTS = """
counts AS (
  SELECT cell_id, atse_id, junction_id, CAST(count(*) AS DOUBLE) AS y
  FROM purchases GROUP BY cell_id, atse_id, junction_id)"""

OBS = """
obs AS (
  SELECT *, sum(y) OVER (PARTITION BY cell_id, atse_id) AS n FROM counts)"""

CELLS = """
cells AS (
  SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, CAST(c_nationkey AS VARCHAR) AS tissue,
         nullif(c_mktsegment, 'BUILDING') AS partial_label
  FROM customer)"""

JUNCTIONS = """
junctions AS (
  SELECT DISTINCT concat(p_brand, '|', p_type) AS junction_id, p_brand AS atse_id, p_brand AS gene_id,
         CASE WHEN p_type <> 'ECONOMY' THEN lower(concat(p_brand, ' ', p_type)) END AS gene_name
  FROM part)"""

CENTERED = """
weighted AS (
  SELECT *, y / n AS psi, n / (CAST(1 AS DOUBLE) + (n - 1) * CAST(0.1 AS DOUBLE)) AS w FROM obs WHERE n <> 0),
means AS (
  SELECT junction_id, sum(w * psi) / sum(w) AS junction_mean FROM weighted GROUP BY junction_id),
centered AS (
  SELECT weighted.*, w * psi AS w_psi, junction_mean, psi - junction_mean AS centered
  FROM weighted JOIN means USING (junction_id))"""

PSI = """
psi AS (
  SELECT factor_idx, junction_id, y / sum(y) OVER (PARTITION BY factor_idx, atse_id) AS psi
  FROM (SELECT factor_idx, atse_id, junction_id, CAST(count(*) AS DOUBLE) AS y
        FROM purchases GROUP BY factor_idx, atse_id, junction_id) t)"""

PHI = """
phi AS (
  SELECT cell_id, factor_idx, y / sum(y) OVER (PARTITION BY cell_id) AS phi
  FROM (SELECT cell_id, factor_idx, CAST(count(*) AS DOUBLE) AS y
        FROM purchases GROUP BY cell_id, factor_idx) t)"""

PI = """
pi AS (
  SELECT factor_idx, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM purchases) AS pi
  FROM purchases GROUP BY factor_idx)"""

PSI_SAMPLES = """
psi_samples AS (
  SELECT sample, factor_idx, junction_id, y / sum(y) OVER (PARTITION BY sample, factor_idx, atse_id) AS psi
  FROM (SELECT sample, factor_idx, atse_id, junction_id, CAST(count(*) AS DOUBLE) AS y
        FROM purchases GROUP BY sample, factor_idx, atse_id, junction_id) t)"""

PHI_SAMPLES = """
phi_samples AS (
  SELECT sample, cell_id, factor_idx, y / sum(y) OVER (PARTITION BY sample, cell_id) AS phi
  FROM (SELECT sample, cell_id, factor_idx, CAST(count(*) AS DOUBLE) AS y
        FROM purchases GROUP BY sample, cell_id, factor_idx) t)"""

PREDICTED = """
predicted AS (
  SELECT obs.*, greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), p)) AS q, p
  FROM obs JOIN (
    SELECT cell_id, junction_id, sum(phi * psi) AS p
    FROM (SELECT cell_id, junction_id FROM obs) e JOIN phi USING (cell_id) JOIN psi USING (junction_id, factor_idx)
    GROUP BY cell_id, junction_id) d USING (cell_id, junction_id))"""

FACTOR_EFFECTS = """
diffs AS (
  SELECT *, psi - others AS diff FROM (
    SELECT *, CASE WHEN count(*) OVER slot > 1
                   THEN (sum(psi) OVER slot - psi) / (count(*) OVER slot - 1) END AS others
    FROM psi_samples WINDOW slot AS (PARTITION BY junction_id, sample)) t),
effects AS (
  SELECT junction_id, factor_idx, avg(diff) AS effect_size, var_samp(diff) AS effect_size_var,
         avg(CASE WHEN abs(diff) > CAST(0.1 AS DOUBLE) + CAST(1e-12 AS DOUBLE) THEN CAST(1 AS DOUBLE) WHEN diff IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS prob_greater,
         sum(CASE WHEN abs(diff) > CAST(0.1 AS DOUBLE) + CAST(1e-12 AS DOUBLE) THEN CAST(1 AS DOUBLE) WHEN diff IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS num_greater,
         avg(psi) AS psi_factor_mean, avg(others) AS psi_nonfactor_mean
  FROM diffs GROUP BY junction_id, factor_idx)"""


def group_activity(side: str) -> str:
    """CTEs with the mean activity of both sides; ``side`` is a CASE expression over cells."""
    return f"""
sides AS (SELECT cell_id, side FROM (SELECT cell_id, {side} AS side FROM cells) t WHERE side IS NOT NULL),
sizes AS (SELECT sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS n2 FROM sides),
activity AS (
  SELECT sample, factor_idx, sum(CASE WHEN side = 1 THEN phi ELSE 0 END) / (SELECT n1 FROM sizes) AS mean_1,
         sum(CASE WHEN side = 2 THEN phi ELSE 0 END) / (SELECT n2 FROM sizes) AS mean_2
  FROM phi_samples JOIN sides USING (cell_id) GROUP BY sample, factor_idx)"""


PAIR_SIDE = "CASE WHEN cell_type = 'BUILDING' THEN 1 WHEN cell_type = 'MACHINERY' THEN 2 END"
REST_SIDE = "CASE WHEN partial_label = 'MACHINERY' THEN 1 ELSE 2 END"


def group_effects(delta: str) -> str:
    """CTEs with the per-sample means and the effect of every junction."""
    return f"""
per_sample AS (
  SELECT junction_id, sample, sum(psi * mean_1) AS m1, sum(psi * mean_2) AS m2
  FROM psi_samples JOIN activity USING (sample, factor_idx) GROUP BY junction_id, sample),
effects AS (
  SELECT junction_id, avg(m1 - m2) AS effect_size, var_samp(m1 - m2) AS effect_size_var,
         avg(CASE WHEN abs(m1 - m2) > CAST({delta} AS DOUBLE) + CAST(1e-12 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS prob_greater,
         sum(CASE WHEN abs(m1 - m2) > CAST({delta} AS DOUBLE) + CAST(1e-12 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS num_greater
  FROM per_sample GROUP BY junction_id)"""


def fdr(group: str, delta: str, threshold: str) -> str:
    """CTE ``scored``: running-mean FDR over ``effects`` within ``group`` (may be empty)."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""
ranked AS (
  SELECT *, abs(effect_size) AS abs_effect_size,
         avg(1 - prob_greater) OVER ({part} ORDER BY prob_greater DESC, junction_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fdr_curve
  FROM effects),
flagged AS (
  SELECT *, coalesce(fdr_curve <= CAST({threshold} AS DOUBLE) + CAST(1e-12 AS DOUBLE) AND abs_effect_size > CAST({delta} AS DOUBLE) + CAST(1e-12 AS DOUBLE), false) AS significant FROM ranked),
scored AS (
  SELECT *, CAST(sum(CASE WHEN significant THEN 1 ELSE 0 END) OVER ({part}) AS BIGINT) AS n_significant FROM flagged)"""


def quantiles(value: str) -> str:
    return ", ".join(
        f"round(quantile_cont({value}, {q}), 6) AS {name}" for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
