"""SQL texts of the catalogue queries, for an engine that is not Spark.

Each text is written from the definitions alone: plain windows, joins and
exact quantiles over the same views, without any of the buckets, carry rows
or stored profiles of the Spark side.
"""

from __future__ import annotations

from shiftspark.plans.fixtures import EVENT_LONG_SQL, EVENT_SQL, LONG_SQL, OBS_SQL


def r(name: str, expr: str | None = None, places: int = 6) -> str:
    return f"round({expr or name}, {places}) + 0e0 AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def sql(*parts: str) -> str:
    """The last part is the SELECT, the others are the WITH entries."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()


OBS = (OBS_SQL,)
LONG = (OBS_SQL, LONG_SQL)

MOMENTS = """
moments AS (
  SELECT scenario, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
         min(value) AS min, max(value) AS max, quantile_cont(value, 5e-1) AS median
  FROM long GROUP BY scenario, feature)
"""

EFFECTS = """
effects AS (
  SELECT p.scenario, p.feature, b.mean AS mean_baseline, p.mean AS mean_prod,
    CASE WHEN sqrt((b.std * b.std + p.std * p.std) / 2e0) > 0
         THEN (b.mean - p.mean) / sqrt((b.std * b.std + p.std * p.std) / 2e0) ELSE 0e0 END AS cohens_d,
    b.mean - p.mean AS mean_diff, b.std - p.std AS std_diff, p.mean - b.mean AS mean_shift
  FROM moments p JOIN moments b ON b.feature = p.feature AND b.scenario = 'Baseline'
  WHERE p.scenario <> 'Baseline')
"""

KS = """
names AS (SELECT DISTINCT scenario FROM obs WHERE scenario <> 'Baseline'),
pooled AS (
  SELECT s.scenario, l.feature, l.value,
    count(*) FILTER (WHERE l.scenario = 'Baseline') AS nb,
    count(*) FILTER (WHERE l.scenario <> 'Baseline') AS np
  FROM names s JOIN long l ON l.scenario = 'Baseline' OR l.scenario = s.scenario
  GROUP BY s.scenario, l.feature, l.value),
cumulated AS (
  SELECT scenario, feature,
    sum(nb) OVER (PARTITION BY scenario, feature ORDER BY value) AS cb,
    sum(np) OVER (PARTITION BY scenario, feature ORDER BY value) AS cp,
    sum(nb) OVER (PARTITION BY scenario, feature) AS tb,
    sum(np) OVER (PARTITION BY scenario, feature) AS tp
  FROM pooled),
distances AS (
  SELECT scenario, feature, max(abs(CAST(cb AS DOUBLE) / tb - CAST(cp AS DOUBLE) / tp)) AS ks_statistic,
    CAST(max(tb) AS BIGINT) AS n_baseline, CAST(max(tp) AS BIGINT) AS n_prod
  FROM cumulated WHERE tb > 0 AND tp > 0 GROUP BY scenario, feature),
scaled AS (
  SELECT *, CAST(n_baseline AS DOUBLE) * n_prod / (n_baseline + n_prod) AS en FROM distances),
lambdas AS (
  SELECT *, ks_statistic * sqrt(en) + 1e0 / (6e0 * sqrt(en)) + (ks_statistic * sqrt(en) - 1e0) / (4e0 * en) AS lam
  FROM scaled),
rated AS (
  SELECT scenario, feature, ks_statistic, n_baseline, n_prod,
    CASE WHEN lam < 2e-1 THEN 1e0 ELSE greatest(0e0, least(1e0, 2e0 * list_sum(list_transform(range(1, 101),
      lambda j: (CASE WHEN j % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * j * j * lam * lam))))) END AS p_value
  FROM lambdas),
tests AS (SELECT *, p_value < 5e-2 AS drifted FROM rated)
"""

SHARES = """
shares AS (
  SELECT scenario, count(*) FILTER (WHERE drifted) AS n_drifted, count(*) AS n_tested,
    count(*) FILTER (WHERE drifted) / {declared} AS drift_share,
    count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) AS tested_share
  FROM tests GROUP BY scenario)
"""

PSI = """
spans AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long WHERE scenario = 'Baseline' GROUP BY feature),
edges AS (
  SELECT feature, i, lo, hi,
    CASE WHEN i = 0 THEN lo - 1e-6 ELSE lo + i * ((hi - lo) / 1e1) END AS e0,
    CASE WHEN i = 9 THEN hi + 1e-6 ELSE lo + (i + 1) * ((hi - lo) / 1e1) END AS e1
  FROM spans CROSS JOIN (SELECT range AS i FROM range(10))),
binned AS (
  SELECT l.scenario, l.feature, i, count(*) AS n,
    count(*) FILTER (WHERE value >= e0 AND (value < e1 OR (i = 9 AND value <= e1))) AS c
  FROM long l JOIN edges e ON e.feature = l.feature GROUP BY l.scenario, l.feature, i),
binshares AS (
  SELECT scenario, feature, i, CASE WHEN c = 0 THEN 1e-6 ELSE CAST(c AS DOUBLE) / n END AS q FROM binned),
psis AS (
  SELECT p.scenario, p.feature, sum((p.q - b.q) * ln(p.q / b.q)) AS psi
  FROM binshares p JOIN binshares b ON b.feature = p.feature AND b.i = p.i AND b.scenario = 'Baseline'
  WHERE p.scenario <> 'Baseline' GROUP BY p.scenario, p.feature),
avgpsi AS (SELECT scenario, avg(psi) AS avg_psi FROM psis GROUP BY scenario)
"""


def evaluation(score: str = "Probability", prediction: str = "Prediction", tag: str = "") -> str:
    return f"""
ranked{tag} AS (
  SELECT scenario, s, pos, neg, sum(neg) OVER (PARTITION BY scenario ORDER BY s) AS upto FROM (
    SELECT scenario, {score} AS s, count(*) FILTER (WHERE Class = 1) AS pos,
      count(*) FILTER (WHERE Class = 0) AS neg FROM obs WHERE {score} IS NOT NULL GROUP BY scenario, {score})),
areas{tag} AS (
  SELECT scenario, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
    THEN sum(pos * ((upto - neg) + 5e-1 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc_roc
  FROM ranked{tag} GROUP BY scenario),
cells{tag} AS (
  SELECT scenario, count(*) AS n_rows, avg(CAST(Class AS DOUBLE)) AS positive_rate,
    count(*) FILTER (WHERE Class = 0 AND {prediction} = 0) AS tn,
    count(*) FILTER (WHERE Class = 0 AND {prediction} = 1) AS fp,
    count(*) FILTER (WHERE Class = 1 AND {prediction} = 0) AS fn,
    count(*) FILTER (WHERE Class = 1 AND {prediction} = 1) AS tp
  FROM obs GROUP BY scenario),
metrics{tag} AS (
  SELECT c.*, a.auc_roc,
    CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0e0 END AS f1_score
  FROM cells{tag} c LEFT JOIN areas{tag} a ON a.scenario = c.scenario)
"""


EVAL = evaluation()

COMPARED = """
compared AS (
  SELECT m.*, b.f1_score AS base_f1_score, b.auc_roc AS base_auc_roc, b.precision AS base_precision,
    b.recall AS base_recall, m.f1_score - b.f1_score AS delta_f1_score, m.auc_roc - b.auc_roc AS delta_auc_roc,
    m.precision - b.precision AS delta_precision, m.recall - b.recall AS delta_recall
  FROM metrics m CROSS JOIN (SELECT * FROM metrics WHERE scenario = 'Baseline') b)
"""

DECISION = """
rows AS (
  SELECT c.*, coalesce(s.n_drifted, 0) AS n_drifted, coalesce(s.n_tested, 0) AS n_tested,
    base_f1_score - f1_score AS f1_drop, base_auc_roc - auc_roc AS auc_drop
  FROM compared c LEFT JOIN shares s ON s.scenario = c.scenario WHERE c.scenario <> 'Baseline')
"""

OBS_SHARES = SHARES.format(declared="4e0")
TESTS = (*LONG, KS)
DECIDED = (*LONG, KS, OBS_SHARES, EVAL, COMPARED, DECISION)

EVENTS = (EVENT_SQL, EVENT_LONG_SQL)


def row_hash_sql(keys: list[str]) -> str:
    one = lambda e: f"((({e}) % 2147483648) * 2654435761) % 4294967296"
    h = one(keys[0])
    for k in keys[1:]:
        h = one(f"({h}) + {k}")
    return h


def count_status(retrain, warn, labels) -> dict[str, str]:
    """Status and reasons of a count policy as SQL expressions."""

    def conds(limits, note):
        out = [(f"n_drifted >= {limits[0]}", f"n_drifted || ' features drifted{note}'")]
        out.append((f"f1_drop > {limits[1]}", "'F1 dropped by ' || printf('%.4f', f1_drop)"))
        if limits[2]:
            out.append((f"auc_drop > {limits[2]}", "'AUC-ROC dropped by ' || printf('%.4f', auc_drop)"))
        return out

    hard, soft = conds(retrain[:3], retrain[3]), conds(warn[:3], warn[3])
    any_of = lambda cs: " OR ".join(f"coalesce({c}, false)" for c, _ in cs)
    text = lambda cs: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in cs) + ")"
    return {
        "status": f"CASE WHEN {any_of(hard)} THEN '{labels[0]}' WHEN {any_of(soft)} THEN '{labels[1]}' ELSE '{labels[2]}' END",
        "color": f"CASE WHEN {any_of(hard)} THEN 'red' WHEN {any_of(soft)} THEN 'orange' ELSE 'green' END",
        "reasons": f"CASE WHEN {any_of(hard)} THEN {text(hard)} WHEN {any_of(soft)} THEN {text(soft)} ELSE '{labels[3]}' END",
    }


RATIO = """
ratio AS (
  SELECT *, n_drifted / {declared} AS drift_share,
    n_drifted / {declared} > 3e-1 AS hit_share,
    coalesce(f1_score IS NOT NULL AND f1_drop > 5e-2, false) AS hit_f1,
    coalesce(f1_score IS NOT NULL AND auc_drop > 3e-2, false) AS hit_auc
  FROM rows),
ratio_decided AS (
  SELECT *, hit_share OR hit_f1 OR hit_auc AS retrain,
    concat_ws('; ',
      CASE WHEN hit_share THEN n_drifted || '/{n} features drifted (' || printf('%.1f', drift_share * 1e2) || '% > 30%)' END,
      CASE WHEN hit_f1 THEN 'F1 dropped ' || printf('%.4f', f1_drop) || ' (threshold 0.05)' END,
      CASE WHEN hit_auc THEN 'AUC-ROC dropped ' || printf('%.4f', auc_drop) || ' (threshold 0.03)' END) AS reasons,
    CASE WHEN hit_share OR hit_f1 OR hit_auc THEN concat_ws('; ',
      CASE WHEN hit_share THEN 'Warning: ' || printf('%.1f', drift_share * 1e2) || '% of features show significant drift' END,
      CASE WHEN hit_f1 THEN 'Warning: F1 degraded by ' || printf('%.4f', f1_drop) END,
      CASE WHEN hit_auc THEN 'Warning: AUC-ROC degraded by ' || printf('%.4f', auc_drop) END)
    ELSE 'All metrics within acceptable range - no retraining needed.' END AS alerts
  FROM ratio)
"""
OBS_RATIO = RATIO.format(declared="4e0", n=4)
EVENT_RATIO = RATIO.format(declared="2e0", n=2)
