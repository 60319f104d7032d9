"""Every query by name, with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.display import direction, rounded, shown, sign_label
from shiftspark.functions.stats import KS_EXACT_ROWS, d
from shiftspark.operators import drift, evaluate, policy, prepare, profile, psi, reports
from shiftspark.operators.select import (
    common_features,
    features_long,
    scenario_filter,
    split_label,
    strict_select,
    winsorize,
)
from shiftspark.plans import monitoring
from shiftspark.plans import oracle as o
from shiftspark.plans.fixtures import (
    ACCOUNT_SPEC,
    ACCOUNT_SQL,
    EVENT_SPEC,
    OBS_SPEC,
    SCENARIOS,
    WIDE_SPEC,
    WIDE_SQL,
    account_obs,
    event_obs,
    obs,
    obs_two_scores,
    wide_obs,
)
from shiftspark.sources import readers
from shiftspark.sources.profile_store import Profile, grow_profile, read_profile, write_profile
from shiftspark.sources.writers import shared_folder, stored, write_csv, write_json
from shiftspark.spec import (
    COUNT_POLICY,
    DEGRADED_MARGIN,
    INLINE_POLICY,
    PSI_FULL_RETRAIN,
    RATIO_POLICY,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SPEC = OBS_SPEC
FEATURES = list(OBS_SPEC.features)
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(name: str, *sql_parts: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql_parts:
            ORACLES[name] = o.sql(*sql_parts)
        return fn

    return add


# ---------------------------------------------------------------- sources


@query(
    "csv_scenarios",
    *o.OBS,
    f"""SELECT scenario, count(*) AS n_rows, count(tax) AS n_tax, {o.r('sum_qty', 'sum(qty)')},
    {o.r('sum_price', 'sum(price)', 2)}, sum(Class) :: BIGINT AS n_positive FROM obs GROUP BY scenario""",
)
def csv_scenarios(spark, sf):
    """Batches written as CSV folders and read back in one scan; the last one
    has its columns in another order and lacks one."""
    table = obs(spark, sf).select("scenario", *FEATURES, "Class", "Prediction", "Probability")
    base = shared_folder(spark)
    last = SCENARIOS[-1]
    table.filter(F.col("scenario") != last).write.partitionBy("scenario").option("header", True).csv(f"{base}/a")
    rest = table.filter(F.col("scenario") == last).select(*reversed([c for c in table.columns if c not in ("tax", "scenario")]))
    write_csv(rest, f"{base}/b/scenario={last}")
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), "scenario=([^/]+)/", 1)
    back = readers.read_files(spark, f"{base}/*/*/*.csv", SPEC, name=name)
    return rounded(
        back.groupBy("scenario").agg(
            F.count("*").alias("n_rows"),
            F.count("tax").alias("n_tax"),
            F.sum("qty").alias("sum_qty"),
            F.round(F.sum("price"), 2).alias("sum_price"),
            F.sum("Class").alias("n_positive"),
        )
    )


@query(
    "score_input",
    *o.OBS,
    f"""SELECT scenario, CASE WHEN Probability >= 6e-1 THEN 1 ELSE 0 END AS prediction, count(*) AS n_rows,
    {o.r('avg_probability', 'avg(Probability)')} FROM obs GROUP BY 1, 2""",
)
def score_input(spark, sf):
    """A CSV of all rows to score with its columns in another order; labels at 0.6."""
    path = shared_folder(spark)
    write_csv(obs(spark, sf).select("Class", *reversed(FEATURES), F.col("Probability").alias("probability"), "scenario"), path)
    back = readers.read_labelled(spark, path, SPEC)
    ready = strict_select(back, ["scenario", *FEATURES, "probability"])
    labelled = ready.withColumn("probability", F.col("probability").cast("double")).withColumn(
        "prediction", evaluate.label_at(F.col("probability"), 0.6)
    )
    return rounded(
        labelled.groupBy("scenario", "prediction").agg(
            F.count("*").alias("n_rows"), F.avg("probability").alias("avg_probability")
        )
    )


@query(
    "metrics_json",
    *o.OBS,
    o.EVAL,
    f"""SELECT 'threshold rule' AS baseline_model, n_rows AS test_set_size, {o.rs(*evaluate.METRICS)}
    FROM metrics WHERE scenario = 'Baseline'""",
)
def metrics_json(spark, sf):
    """The baseline record written as JSON and read back."""
    path = shared_folder(spark)
    report = reports.baseline_report(evaluate.evaluate(obs(spark, sf), SPEC), SPEC, "lineitem", "threshold rule")
    write_json(report, path)
    return rounded(readers.read_metrics(spark, path))


@query(
    "baseline_profile",
    *o.LONG,
    f"""SELECT feature, count(*) AS n, count(DISTINCT value) AS n_distinct, {o.r('mean', 'avg(value)')},
    {o.r('lo', 'min(value)')}, {o.r('hi', 'max(value)')} FROM long WHERE scenario = 'Baseline' GROUP BY feature""",
)
def baseline_profile(spark, sf):
    """The profile stored and opened again, condensed to one row per feature."""
    path = shared_folder(spark)
    write_profile(obs(spark, sf), SPEC, path)
    return _condensed(read_profile(spark, SPEC, path))


def _condensed(p: Profile) -> DataFrame:
    values = p.counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    counts = values.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))
    ends = p.moments.select("feature", "mean", F.col("min").alias("lo"), F.col("max").alias("hi"))
    return rounded(counts.join(ends, "feature"))


@query(
    "profile_growth",
    *o.LONG,
    o.EVAL,
    f"""SELECT feature, count(*) AS n, count(DISTINCT value) AS n_distinct, {o.r('mean', 'avg(value)')},
    {o.r('lo', 'min(value)')}, {o.r('hi', 'max(value)')}, {o.r('std', 'stddev_samp(value)')},
    (SELECT {o.r('auc_roc').split(' AS ')[0]} FROM metrics WHERE scenario = 'Baseline') AS auc_roc
    FROM long WHERE scenario = 'Baseline' GROUP BY feature""",
)
def profile_growth(spark, sf):
    """The profile of a third of the baseline's orders, grown by the other two thirds one after the other."""
    path = shared_folder(spark)
    rows = obs(spark, sf)
    third = F.pmod(F.col("l_orderkey"), F.lit(3))
    write_profile(rows.filter(third == 0), SPEC, path)
    for part in (1, 2):
        grow_profile(rows.filter(third == part), SPEC, path)
    p = read_profile(spark, SPEC, path)
    std = rounded(p.moments.select("feature", "std").withColumn("auc_roc", F.lit(p.metrics["auc_roc"]).cast("double")))
    return _condensed(p).join(std, "feature")


# -------------------------------------------------------------- selection


@query("strict_select", *o.OBS, f"SELECT {', '.join(reversed(FEATURES))} FROM obs")
def strict(spark, sf):
    return strict_select(obs(spark, sf), list(reversed(FEATURES)))


@query("feature_label_split", *o.OBS, "SELECT Class, count(*) AS n_rows FROM obs GROUP BY Class")
def feature_label(spark, sf):
    _, labels = split_label(obs(spark, sf), SPEC)
    return labels.groupBy("Class").agg(F.count("*").alias("n_rows"))


@query(
    "common_features",
    *o.LONG,
    f"""SELECT scenario, feature, count(*) AS n, {o.r('mean', 'avg(value)')} FROM long
    WHERE feature <> 'tax' GROUP BY scenario, feature""",
)
def common(spark, sf):
    """Means of the features that the whole table and batches without ``tax`` share, for all scenarios."""
    table = obs(spark, sf)
    batches = table.drop("tax")
    have = common_features(SPEC, table, batches)
    long = features_long(batches, SPEC.with_features(*have))
    return rounded(long.groupBy("scenario", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(
    "non_null_counts", *o.LONG, "SELECT scenario, feature, count(*) AS n FROM long GROUP BY scenario, feature"
)
def non_null(spark, sf):
    return features_long(obs(spark, sf), SPEC).groupBy("scenario", "feature").agg(F.count("*").alias("n"))


@query(
    "scenario_filter",
    *o.OBS,
    "SELECT scenario, l_orderkey, l_linenumber, qty, price FROM obs WHERE scenario IN ('Drift 2', 'Drift 3')",
)
def by_scenario(spark, sf):
    return scenario_filter(obs(spark, sf), SPEC, "Drift 2", "Drift 3").select(
        "scenario", "l_orderkey", "l_linenumber", "qty", "price"
    )


@query(
    "default_label",
    *o.OBS,
    "SELECT scenario, CASE WHEN Probability > 5e-1 THEN 1 ELSE 0 END AS label, count(*) AS n FROM obs GROUP BY 1, 2",
)
def argmax_label(spark, sf):
    rows = obs(spark, sf).withColumn("label", evaluate.default_label(F.col("Probability")))
    return rows.groupBy("scenario", "label").agg(F.count("*").alias("n"))


@query(
    "score_threshold",
    *o.OBS,
    """SELECT scenario, CASE WHEN Probability >= 5e-1 THEN 1 ELSE 0 END AS label, count(*) AS n FROM obs
    GROUP BY 1, 2""",
)
def threshold_label(spark, sf):
    rows = obs(spark, sf).withColumn("label", evaluate.label_at(F.col("Probability")))
    return rows.groupBy("scenario", "label").agg(F.count("*").alias("n"))


@query(
    "winsorize",
    *o.LONG,
    f"""SELECT scenario, l.feature, {o.r('value', 'greatest(lo, least(hi, value))')} FROM long l JOIN
    (SELECT feature, quantile_cont(value, 1e-2) AS lo, quantile_cont(value, 9.9e-1) AS hi FROM long
     WHERE scenario = 'Baseline' GROUP BY feature) b ON b.feature = l.feature""",
)
def clipped(spark, sf):
    table = obs(spark, sf)
    return rounded(
        winsorize(features_long(table, SPEC), profile.clip_bounds(table, SPEC)).select("scenario", "feature", "value")
    )


# ---------------------------------------------------------------- profile

OVERVIEW_COLS = [*FEATURES, "Class"]


@query(
    "overview",
    *o.OBS,
    """SELECT count(*) AS n_rows, 5 AS n_columns,
    5 * count(*) - count(qty) - count(price) - count(discount) - count(tax) - count(Class) AS n_missing,
    'qty, price, discount, tax, Class' AS columns, 'double, int' AS types FROM obs""",
)
def table_overview(spark, sf):
    return profile.overview(obs(spark, sf), OVERVIEW_COLS)


@query(
    "class_balance",
    *o.OBS,
    f"""SELECT scenario, count(*) AS n_rows, count(*) FILTER (WHERE Class = 1) AS n_positive,
    count(*) FILTER (WHERE Class = 0) AS n_negative, {o.r('positive_rate', 'avg(CAST(Class AS DOUBLE))')}
    FROM obs GROUP BY scenario""",
)
def balance(spark, sf):
    return rounded(profile.class_balance(obs(spark, sf), SPEC))


@query(
    "feature_stats",
    *o.LONG,
    o.MOMENTS,
    f"SELECT scenario, feature, n, {o.rs('mean', 'std', 'min', 'max', 'median')} FROM moments",
)
def stats(spark, sf):
    return rounded(profile.feature_stats(obs(spark, sf), SPEC))


@query(
    "quantile_bounds",
    *o.LONG,
    f"""SELECT scenario, feature, {o.r('q01', 'quantile_cont(value, 1e-2)')}, {o.r('q99', 'quantile_cont(value, 9.9e-1)')}
    FROM long GROUP BY scenario, feature""",
)
def quantiles(spark, sf):
    return rounded(profile.exact_quantiles(obs(spark, sf), SPEC, {"q01": 0.01, "q99": 0.99}))


CLIPPED_SQL = """
bounds AS (SELECT feature, quantile_cont(value, 1e-2) AS lo, quantile_cont(value, 9.9e-1) AS hi FROM long
           WHERE scenario = 'Baseline' GROUP BY feature),
clipped AS (SELECT scenario, l.feature, greatest(lo, least(hi, value)) AS v FROM long l
            JOIN bounds b ON b.feature = l.feature),
spans AS (
  SELECT scenario, feature, count(*) AS n, CASE WHEN min(v) = max(v) THEN min(v) - 5e-1 ELSE min(v) END AS a,
    CASE WHEN min(v) = max(v) THEN max(v) + 5e-1 ELSE max(v) END AS z FROM clipped GROUP BY scenario, feature)
"""


@query(
    "hist_density",
    *o.LONG,
    CLIPPED_SQL,
    f"""SELECT s.scenario, s.feature, CAST(i AS INTEGER) AS bin, {o.r('left_edge', 'a + i * ((z - a) / 6e1)')},
      count(v) AS count, {o.r('density', 'count(v) / (n * ((z - a) / 6e1))')}
    FROM spans s CROSS JOIN (SELECT range AS i FROM range(60)) g
    LEFT JOIN clipped c ON c.scenario = s.scenario AND c.feature = s.feature
      AND v >= a + i * ((z - a) / 6e1) AND (v < a + (i + 1) * ((z - a) / 6e1) OR i = 59)
    GROUP BY s.scenario, s.feature, i, a, z, n""",
)
def histogram(spark, sf):
    return rounded(profile.density_histogram(obs(spark, sf), SPEC))


@query(
    "prob_hist_by_class",
    *o.OBS,
    f"""SELECT Class, CAST(i AS INTEGER) AS bin, {o.r('left_edge', 'a + i * ((z - a) / 5e1)')}, count(p) AS count
    FROM (SELECT Class, min(Probability) AS a, max(Probability) AS z FROM obs WHERE scenario = 'Baseline' GROUP BY Class) s
    CROSS JOIN (SELECT range AS i FROM range(50)) g
    LEFT JOIN (SELECT Class AS k, Probability AS p FROM obs WHERE scenario = 'Baseline') c
      ON k = Class AND p >= a + i * ((z - a) / 5e1) AND (p < a + (i + 1) * ((z - a) / 5e1) OR i = 49)
    GROUP BY Class, i, a, z""",
)
def score_hist(spark, sf):
    return rounded(profile.score_histogram(obs(spark, sf).filter(F.col("scenario") == "Baseline"), SPEC))


@query(
    "kde_curve",
    *o.LONG,
    """base AS (
      SELECT scenario, feature, count(*) AS n, min(value) AS a, max(value) AS z,
        stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -2e-1) AS h
      FROM long GROUP BY scenario, feature HAVING count(*) > 1 AND stddev_samp(value) > 1e-12),
    counts AS (SELECT scenario, feature, value, count(*) AS w FROM long GROUP BY scenario, feature, value),
    points AS (
      SELECT b.*, i, a - (z - a) * 5e-1 + i * ((z - a) * 2e0 / 9.99e2) AS x
      FROM base b CROSS JOIN (SELECT range AS i FROM range(1000)) g)""",
    f"""SELECT p.scenario, p.feature, CAST(i AS INTEGER) AS point, {o.r('x', 'x')},
      {o.r('density', 'sum(w * exp(-5e-1 * pow((x - value) / h, 2e0))) / (n * h * sqrt(2e0 * pi()))')}
    FROM points p JOIN counts k ON k.scenario = p.scenario AND k.feature = p.feature
    GROUP BY p.scenario, p.feature, i, x, n, h""",
)
def kde(spark, sf):
    return rounded(profile.kde_curve(obs(spark, sf), SPEC))


# ------------------------------------------------------------------ drift


@query(
    "ks_drift",
    *o.TESTS,
    f"SELECT scenario, feature, {o.rs('ks_statistic', 'p_value')}, n_baseline, n_prod, drifted FROM tests",
)
def ks(spark, sf):
    return rounded(drift.ks_test(obs(spark, sf), SPEC))


@query(
    "ks_exact",
    "RECURSIVE " + ACCOUNT_SQL.strip(),
    o.KS.replace("'Baseline'", "'BUILDING'"),
    # The chance of each lattice point on a diagonal, paths that left the band left out.
    """walk AS (
      SELECT scenario, feature, n_baseline AS m, n_prod AS n, CAST(round(ks_statistic * n_baseline * n_prod) AS BIGINT) AS w,
        CAST(0 AS BIGINT) AS s, [1e0] AS a FROM tests
      UNION ALL
      SELECT scenario, feature, m, n, w, s + 1, list_transform(range(0, m + 1), lambda i:
        CASE WHEN abs(i * (m + n) - (s + 1) * m) < w AND i <= s + 1 AND s + 1 - i <= n
          THEN (coalesce(a[i + 1], 0e0) * (n - s + i) + coalesce(a[i], 0e0) * (m - i + 1)) / (m + n - s) ELSE 0e0 END)
      FROM walk WHERE s < m + n)""",
    f"""SELECT scenario, feature, {o.r('ks_statistic', 't.ks_statistic')}, n_baseline, n_prod, {o.r('p_value', '1e0 - a[m + 1]')},
    1e0 - a[m + 1] < 5e-2 AS drifted FROM tests t JOIN walk k USING (scenario, feature) WHERE s = m + n""",
)
def ks_small(spark, sf):
    """Tests of small samples with the exact p-value."""
    return rounded(drift.ks_test(account_obs(spark, sf), ACCOUNT_SPEC, exact_rows=KS_EXACT_ROWS))


@query(
    "drift_share",
    *o.TESTS,
    o.OBS_SHARES,
    f"SELECT scenario, n_drifted, n_tested, {o.rs('drift_share', 'tested_share')} FROM shares",
)
def share(spark, sf):
    return rounded(drift.drift_share(drift.ks_test(obs(spark, sf), SPEC), SPEC))


TABLE = (*o.TESTS, o.MOMENTS, o.EFFECTS)
JOINED = "tests t JOIN effects e ON e.scenario = t.scenario AND e.feature = t.feature"


@query(
    "drift_summary",
    *TABLE,
    f"""SELECT t.scenario, count(*) FILTER (WHERE p_value < 5e-2) AS n_significant, count(*) AS n_tested,
    {o.r('max_effect', 'max(abs(cohens_d))')} FROM {JOINED} GROUP BY t.scenario""",
)
def summary(spark, sf):
    return rounded(drift.drift_summary(drift.drift_table(obs(spark, sf), SPEC)))


@query(
    "drift_table",
    *TABLE,
    f"""SELECT t.scenario, t.feature, {o.rs('ks_statistic', 'p_value', 'mean_baseline', 'mean_prod', 'cohens_d',
    'mean_diff', 'std_diff', 'mean_shift')}, n_baseline, n_prod, drifted FROM {JOINED}""",
)
def table(spark, sf):
    return rounded(drift.by_ks(drift.drift_table(obs(spark, sf), SPEC)))


@query(
    "effect_size",
    *o.LONG,
    o.MOMENTS,
    o.EFFECTS,
    f"SELECT scenario, feature, {o.rs('cohens_d', 'mean_diff', 'std_diff')} FROM effects",
)
def effect(spark, sf):
    return rounded(
        drift.moment_shift(obs(spark, sf), SPEC).select("scenario", "feature", "cohens_d", "mean_diff", "std_diff")
    )


@query(
    "mean_shift",
    *o.LONG,
    o.MOMENTS,
    o.EFFECTS,
    f"SELECT scenario, feature, {o.rs('mean_baseline', 'mean_prod', 'mean_shift')} FROM effects",
)
def shift(spark, sf):
    return rounded(
        drift.moment_shift(obs(spark, sf), SPEC).select(
            "scenario", "feature", "mean_baseline", "mean_prod", "mean_shift"
        )
    )


def _top_sql(k: int, by: str, source: str) -> str:
    return f"""SELECT scenario, feature, {o.r(by)}, CAST(rank AS INTEGER) AS rank FROM (
    SELECT scenario, feature, {by}, row_number() OVER (PARTITION BY scenario ORDER BY {by} DESC, feature) AS rank
    FROM {source}) WHERE rank <= {k}"""


@query("top3_effect", *o.LONG, o.MOMENTS, o.EFFECTS, _top_sql(3, "effect", "(SELECT *, abs(cohens_d) AS effect FROM effects)"))
def top3(spark, sf):
    t = drift.moment_shift(obs(spark, sf), SPEC).withColumn("effect", F.abs("cohens_d"))
    return rounded(drift.top_features(t, 3, F.col("effect")).select("scenario", "feature", "effect", "rank"))


def _top_ks(k: int) -> Query:
    def run(spark, sf):
        t = drift.ks_test(obs(spark, sf), SPEC)
        return rounded(
            drift.top_features(t, k, F.col("ks_statistic")).select("scenario", "feature", "ks_statistic", "rank")
        )

    return run


query("top10_ks", *o.TESTS, _top_sql(10, "ks_statistic", "tests"))(_top_ks(10))
query("top15_ks", *o.TESTS, _top_sql(15, "ks_statistic", "tests"))(_top_ks(15))


# Thirty features, so that the lists are cut.
WIDE_TESTS = (WIDE_SQL, o.KS)


def _top_wide(k: int) -> Query:
    def run(spark, sf):
        t = drift.ks_test(wide_obs(spark, sf), WIDE_SPEC)
        return rounded(drift.top_features(t, k, F.col("ks_statistic")).select("scenario", "feature", "ks_statistic", "rank"))

    return run


query("top10_wide", *WIDE_TESTS, _top_sql(10, "ks_statistic", "tests"))(_top_wide(10))
query("top15_wide", *WIDE_TESTS, _top_sql(15, "ks_statistic", "tests"))(_top_wide(15))


@query(
    "drift_share_wide",
    *WIDE_TESTS,
    o.SHARES.format(declared="3e1"),
    f"SELECT scenario, n_drifted, n_tested, {o.rs('drift_share', 'tested_share')} FROM shares",
)
def share_wide(spark, sf):
    return rounded(drift.drift_share(drift.ks_test(wide_obs(spark, sf), WIDE_SPEC), WIDE_SPEC))


@query(
    "top_feature",
    *o.TESTS,
    f"""SELECT scenario, {o.r('max_ks', 'ks_statistic')}, feature AS top_feature FROM (
    SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY ks_statistic DESC, feature) AS k FROM tests) WHERE k = 1""",
)
def top1(spark, sf):
    return rounded(drift.top_feature(drift.ks_test(obs(spark, sf), SPEC)))


def _matrix_sql(value: str, source: str, rows: str, across: str, names: list[str], fill: bool = False) -> str:
    cell = lambda n: f"max(CASE WHEN {across} = '{n}' THEN {value} END)"
    wrap = (lambda e: f"coalesce({e}, 0e0)") if fill else (lambda e: e)
    return ", ".join(f'round({wrap(cell(n))}, 6) + 0e0 AS "{n}"' for n in names) + f" FROM {source} GROUP BY {rows}"


@query(
    "ks_matrix",
    *o.TESTS,
    f"SELECT feature, {o.r('max_ks', 'max(ks_statistic)')}, "
    + _matrix_sql("ks_statistic", "tests", "feature", "scenario", SCENARIOS, fill=True),
)
def ks_mat(spark, sf):
    return rounded(drift.ks_matrix(drift.ks_test(obs(spark, sf), SPEC), SCENARIOS))


@query("pvalue_matrix", *o.TESTS, "SELECT scenario, " + _matrix_sql("p_value", "tests", "scenario", "feature", FEATURES))
def p_mat(spark, sf):
    return rounded(drift.scenario_matrix(drift.ks_test(obs(spark, sf), SPEC), "p_value", FEATURES))


@query(
    "effect_matrix",
    *o.LONG,
    o.MOMENTS,
    o.EFFECTS,
    "SELECT scenario, " + _matrix_sql("cohens_d", "effects", "scenario", "feature", FEATURES),
)
def d_mat(spark, sf):
    return rounded(drift.scenario_matrix(drift.moment_shift(obs(spark, sf), SPEC), "cohens_d", FEATURES))


@query(
    "scenario_summary",
    *TABLE,
    f"""SELECT b.scenario, n_rows, {o.r('positive_pct', 'positive_rate * 1e2')}, significant, {o.rs('max_effect')} FROM
    (SELECT scenario, count(*) AS n_rows, avg(CAST(Class AS DOUBLE)) AS positive_rate FROM obs GROUP BY scenario) b JOIN
    (SELECT t.scenario, count(*) FILTER (WHERE p_value < 5e-2) || '/' || count(*) AS significant,
      max(abs(cohens_d)) AS max_effect FROM {JOINED} GROUP BY t.scenario) s ON s.scenario = b.scenario""",
)
def scen_summary(spark, sf):
    # The table is read three times over: bring it down once.
    o_ = obs(spark, sf)
    return rounded(drift.scenario_summary(drift.drift_table(o_, SPEC), profile.class_balance(o_, SPEC)))


@query(
    "feature_deep_dive",
    *TABLE,
    f"""SELECT t.scenario, {o.rs('ks_statistic', 'p_value', 'mean_shift')}, drifted FROM {JOINED}
    WHERE t.feature = 'price'""",
)
def deep_dive(spark, sf):
    """One feature over all batches; the declaration is narrowed, so the scan
    reads no other feature."""
    one = drift.drift_table(obs(spark, sf), SPEC.with_features("price"))
    return rounded(one.select("scenario", "ks_statistic", "p_value", "mean_shift", "drifted"))


@query(
    "feature_page",
    *o.TESTS,
    CLIPPED_SQL,
    f"""bars AS (SELECT s.scenario, CAST(i AS INTEGER) AS bin, a + i * ((z - a) / 3e1) AS left_edge, count(v) / (n * ((z - a) / 3e1)) AS density
      FROM spans s CROSS JOIN (SELECT range AS i FROM range(30)) g
      LEFT JOIN clipped c ON c.scenario = s.scenario AND c.feature = s.feature
        AND v >= a + i * ((z - a) / 3e1) AND (v < a + (i + 1) * ((z - a) / 3e1) OR i = 29)
      WHERE s.feature = 'price' GROUP BY s.scenario, i, a, z, n)""",
    f"""SELECT b.scenario, bin, {o.rs('left_edge', 'density', 'ks_statistic', 'p_value')}, drifted FROM bars b
    LEFT JOIN (SELECT * FROM tests WHERE feature = 'price') t ON t.scenario = b.scenario""",
)
def page_of_feature(spark, sf):
    """One feature's page: its distribution in every scenario beside its test."""
    table_ = obs(spark, sf)
    one = SPEC.with_features("price")
    layout = monitoring.survey(table_, one)
    bars = profile.density_histogram(table_, one, bins=30, layout=layout)
    tests = drift.ks_test(table_, one, layout=layout).select("scenario", "ks_statistic", "p_value", "drifted")
    joined = bars.join(tests, "scenario", "left")
    return rounded(joined.select("scenario", "bin", "left_edge", "density", "ks_statistic", "p_value", "drifted"))


# -------------------------------------------------------------------- psi

PSIS = (*o.LONG, o.PSI)


@query("psi", *PSIS, f"SELECT scenario, feature, {o.rs('psi')} FROM psis")
def psi_all(spark, sf):
    return rounded(psi.psi_table(obs(spark, sf), SPEC))


@query("psi_avg", *PSIS, f"SELECT scenario, {o.rs('avg_psi')} FROM avgpsi")
def psi_mean(spark, sf):
    return rounded(psi.psi_average(psi.psi_table(obs(spark, sf), SPEC)))


@query(
    "psi_severity",
    *PSIS,
    f"""SELECT scenario, feature, {o.rs('psi')},
    CASE WHEN psi > 2e-1 THEN 'red' WHEN psi > 1e-1 THEN 'amber' ELSE 'green' END AS severity FROM psis""",
)
def severity(spark, sf):
    return rounded(psi.psi_table(obs(spark, sf), SPEC).withColumn("severity", psi.psi_severity(F.col("psi"))))


@query(
    "psi_rank",
    *PSIS,
    f"""SELECT feature, {o.rs('mean_psi')}, CAST(row_number() OVER (ORDER BY mean_psi DESC, feature) AS INTEGER) AS rank
    FROM (SELECT feature, avg(psi) AS mean_psi FROM psis GROUP BY feature)""",
)
def rank(spark, sf):
    return rounded(psi.psi_rank(psi.psi_table(obs(spark, sf), SPEC)))


@query("psi_matrix", *PSIS, "SELECT scenario, " + _matrix_sql("psi", "psis", "scenario", "feature", FEATURES))
def psi_mat(spark, sf):
    return rounded(drift.scenario_matrix(psi.psi_table(obs(spark, sf), SPEC), "psi", FEATURES))


@query(
    "full_retrain_trigger",
    *PSIS,
    f"""SELECT scenario, {o.rs('share_over')}, share_over > 5e-1 AS full_retrain FROM
    (SELECT scenario, avg(CASE WHEN psi > 4e-1 THEN 1e0 ELSE 0e0 END) AS share_over FROM psis GROUP BY scenario)""",
)
def full_retrain(spark, sf):
    return rounded(psi.full_retrain_trigger(psi.psi_table(obs(spark, sf), SPEC), PSI_FULL_RETRAIN))


@query(
    "psi_trigger",
    *PSIS,
    f"""SELECT scenario, count(*) FILTER (WHERE psi > 2e-1) AS n_over, {o.r('max_psi', 'max(psi)')},
    count(*) FILTER (WHERE psi > 2e-1) > 0 AS triggered FROM psis GROUP BY scenario""",
)
def psi_trig(spark, sf):
    return rounded(psi.psi_triggered(psi.psi_table(obs(spark, sf), SPEC)))


# -------------------------------------------------------------- evaluation

EVALUATED = (*o.OBS, o.EVAL)


@query("confusion", *EVALUATED, "SELECT scenario, tn, fp, fn, tp FROM cells")
def conf(spark, sf):
    return evaluate.confusion(obs(spark, sf), SPEC)


@query("prf", *EVALUATED, f"SELECT scenario, tn, fp, fn, tp, {o.rs('precision', 'recall', 'f1_score')} FROM metrics")
def prf(spark, sf):
    return rounded(evaluate.with_prf(evaluate.confusion(obs(spark, sf), SPEC)))


@query("auc", *EVALUATED, f"SELECT scenario, {o.rs('auc_roc')} FROM areas")
def auc_all(spark, sf):
    return rounded(evaluate.auc(obs(spark, sf), SPEC))


@query(
    "scenario_eval",
    *EVALUATED,
    f"SELECT scenario, n_rows, {o.rs('positive_rate', *evaluate.METRICS)}, tn, fp, fn, tp FROM metrics",
)
def scen_eval(spark, sf):
    return rounded(evaluate.evaluate(obs(spark, sf), SPEC))


CURVE_SQL = """
curve AS (
  SELECT scenario, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY scenario) AS p, sum(neg) OVER (PARTITION BY scenario) AS n, pos, neg,
    lead(pos) OVER w AS pos_next, lead(neg) OVER w AS neg_next, row_number() OVER w AS place
  FROM ranked WINDOW w AS (PARTITION BY scenario ORDER BY s DESC))
"""


@query(
    "roc_curve",
    *EVALUATED,
    CURVE_SQL,
    f"""SELECT scenario, {o.r('threshold', 's')}, {o.r('fpr', 'CASE WHEN n > 0 THEN fp / CAST(n AS DOUBLE) END')},
    {o.r('tpr', 'CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) END')} FROM curve
    UNION ALL SELECT DISTINCT scenario, NULL, 0e0, 0e0 FROM ranked""",
)
def roc(spark, sf):
    """Every distinct score is a threshold, also where the curve goes straight on."""
    return rounded(evaluate.roc_curve(obs(spark, sf), SPEC, thin=False))


@query(
    "pr_curve",
    *EVALUATED,
    CURVE_SQL,
    f"""SELECT scenario, {o.r('threshold', 's')}, {o.r('precision', 'tp / CAST(tp + fp AS DOUBLE)')},
    {o.r('recall', 'CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 1e0 END')} FROM curve
    UNION ALL SELECT DISTINCT scenario, NULL, 1e0, 0e0 FROM ranked""",
)
def pr(spark, sf):
    return rounded(evaluate.pr_curve(obs(spark, sf), SPEC))


@query(
    "pr_curve_thin",
    *EVALUATED,
    CURVE_SQL,
    f"""SELECT scenario, {o.r('threshold', 's')}, {o.r('precision', 'tp / CAST(tp + fp AS DOUBLE)')},
    {o.r('recall', 'CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 1e0 END')} FROM curve
    WHERE place = 1 OR pos_next IS NULL OR pos > 0 OR pos_next > 0
    UNION ALL SELECT DISTINCT scenario, NULL, 1e0, 0e0 FROM ranked""",
)
def pr_thin(spark, sf):
    """Without the thresholds at which recall stands still."""
    return rounded(evaluate.pr_curve(obs(spark, sf), SPEC, thin=True))


@query(
    "threshold_sweep",
    *o.OBS,
    """cuts AS (SELECT CAST(range AS DOUBLE) / 1e2 AS threshold FROM range(5, 96)),
    swept AS (
      SELECT scenario, threshold, count(*) FILTER (WHERE Class = 0 AND Probability < threshold) AS tn,
        count(*) FILTER (WHERE Class = 0 AND Probability >= threshold) AS fp,
        count(*) FILTER (WHERE Class = 1 AND Probability < threshold) AS fn,
        count(*) FILTER (WHERE Class = 1 AND Probability >= threshold) AS tp
      FROM obs CROSS JOIN cuts GROUP BY scenario, threshold)""",
    f"""SELECT scenario, {o.r('threshold')}, tn, fp, fn, tp,
    {o.r('precision', 'CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END')},
    {o.r('recall', 'CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END')},
    {o.r('f1_score', 'CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0e0 END')}
    FROM swept""",
)
def sweep(spark, sf):
    return rounded(evaluate.threshold_sweep(obs(spark, sf), SPEC))


COMPARISON = (*o.OBS, o.EVAL, o.COMPARED)
DELTAS = [f"delta_{m}" for m in evaluate.METRICS]


def _compared(spark, sf) -> DataFrame:
    return evaluate.compare(evaluate.evaluate(obs(spark, sf), SPEC), SPEC)


@query(
    "impact_compare",
    *COMPARISON,
    f"""SELECT scenario, n_rows, {o.rs('positive_rate', *evaluate.METRICS, *DELTAS)},
    CASE WHEN delta_f1_score IS NULL THEN '' WHEN delta_f1_score >= 0 THEN 'good' ELSE 'bad' END AS f1_sign,
    CASE WHEN delta_f1_score < 0 THEN 'down' ELSE 'up' END AS f1_direction FROM compared""",
)
def impact(spark, sf):
    c = _compared(spark, sf)
    delta = F.col("delta_f1_score")
    return rounded(
        c.select(
            "scenario",
            "n_rows",
            "positive_rate",
            *evaluate.METRICS,
            *DELTAS,
            sign_label(delta).alias("f1_sign"),
            direction(delta).alias("f1_direction"),
        )
    )


@query(
    "impact_view",
    *COMPARISON,
    f"""SELECT scenario, {', '.join(o.r(m, f'coalesce({m}, 0e0)') for m in [*evaluate.METRICS, *DELTAS])},
    printf('%.3f', coalesce(compared.f1_score, 0e0)) AS f1_text, printf('%.2f', coalesce(compared.auc_roc, 0e0)) AS auc_text FROM compared""",
)
def view(spark, sf):
    """The comparison with 0 for absent metrics and text forms."""
    return rounded(evaluate.impact_view(_compared(spark, sf)))


@query("stored_compare", *COMPARISON, f"SELECT scenario, {o.rs(*evaluate.METRICS, *DELTAS)} FROM compared")
def with_stored(spark, sf):
    """Batches compared with a baseline record that was written as JSON and read back."""
    metrics = evaluate.evaluate(obs(spark, sf), SPEC)
    path = shared_folder(spark)
    write_json(reports.baseline_report(metrics, SPEC, "lineitem", "threshold rule"), path)
    record = readers.read_metrics(spark, path).first().asDict()
    return rounded(evaluate.compare_with(metrics, record).select("scenario", *evaluate.METRICS, *DELTAS))


@query(
    "impact_delta", *COMPARISON, f"SELECT scenario, {o.rs(*DELTAS)} FROM compared WHERE scenario <> 'Baseline'"
)
def delta(spark, sf):
    return rounded(evaluate.deltas(_compared(spark, sf), SPEC))


@query(
    "worst_scenario",
    *COMPARISON,
    f"""SELECT scenario, {o.rs('f1_score')} FROM compared WHERE scenario <> 'Baseline'
    ORDER BY compared.f1_score, scenario LIMIT 1""",
)
def worst(spark, sf):
    return rounded(evaluate.worst_scenario(_compared(spark, sf), SPEC))


@query(
    "trend",
    *COMPARISON,
    f"""SELECT CAST(row_number() OVER (ORDER BY scenario) - 1 AS INTEGER) AS ordinal, scenario,
    {o.r('f1_score', 'coalesce(f1_score, 0e0)')}, {o.r('auc_roc', 'coalesce(auc_roc, 0e0)')},
    {o.r('f1_line', 'base_f1_score - 5e-2')}, {o.r('auc_line', 'base_auc_roc - 3e-2')} FROM compared""",
)
def trends(spark, sf):
    return rounded(evaluate.trend(_compared(spark, sf), SPEC, RATIO_POLICY.f1_drop, RATIO_POLICY.auc_drop))


@query(
    "metric_long",
    *COMPARISON,
    " UNION ALL ".join(
        f"""SELECT scenario, '{m}' AS metric, {o.r('value', m)}, {o.r('baseline', f'base_{m}')},
        {o.r('delta', f'delta_{m}')}, {m} < base_{m} - 1e-3 AS degraded FROM compared"""
        for m in evaluate.METRICS
    ),
)
def long_metrics(spark, sf):
    return rounded(evaluate.metric_long(_compared(spark, sf), DEGRADED_MARGIN))


@query(
    "overview_page",
    *o.DECIDED,
    f"""SELECT scenario, n_drifted || '/4' AS features_drifted, {o.r('drift_pct', 'n_drifted / 4e0 * 1e2', 1)},
    {o.r('f1_score', 'f1_score', 4)}, {o.r('delta_f1', 'delta_f1_score', 4)}, {o.r('auc_roc', 'auc_roc', 4)},
    {o.r('positive_pct', 'positive_rate * 1e2', 3)} FROM rows""",
)
def page(spark, sf):
    return monitoring.overview_page(obs(spark, sf), SPEC, RATIO_POLICY)


# ---------------------------------------------------------------- policies


def _decision_rows(spark, sf) -> DataFrame:
    return monitoring.decision_input(obs(spark, sf), SPEC, RATIO_POLICY.alpha)


COUNT_SQL = o.count_status(
    (8, "1e-1", "5e-2", ""), (4, "5e-2", "2e-2", ""), ("RETRAIN", "WARNING", "OK", "No retraining trigger exceeded")
)
INLINE_SQL = o.count_status(
    (8, "1e-1", "5e-2", " (>= 8 threshold)"),
    (4, "5e-2", None, " (>= 4 warning threshold)"),
    ("RETRAIN", "WARNING", "STABLE", "No triggers activated."),
)


def _policy_sql(exprs: dict[str, str]) -> str:
    return f"""SELECT scenario, {exprs['status']} AS status, {exprs['color']} AS color, {o.rs('f1_drop', 'auc_drop')},
    {o.r('drift_ratio', 'CASE WHEN n_tested > 0 THEN n_drifted / CAST(n_tested AS DOUBLE) ELSE 0e0 END')},
    {exprs['reasons']} AS reasons FROM rows"""


def _flat(df: DataFrame, *lists: str) -> DataFrame:
    return rounded(df.withColumns({c: F.concat_ws("; ", c) for c in lists}))


@query("policy_count", *o.DECIDED, _policy_sql(COUNT_SQL))
def count_policy(spark, sf):
    return _flat(policy.count_policy(_decision_rows(spark, sf), COUNT_POLICY), "reasons")


@query("policy_count_wide", *WIDE_TESTS, o.SHARES.format(declared="3e1"), o.EVAL, o.COMPARED, o.DECISION, _policy_sql(COUNT_SQL))
def count_policy_wide(spark, sf):
    """Thirty features: none, some and most of them drift, which takes all levels of the policy."""
    rows = monitoring.decision_input(wide_obs(spark, sf), WIDE_SPEC, RATIO_POLICY.alpha)
    return _flat(policy.count_policy(rows, COUNT_POLICY), "reasons")


@query("policy_inline", *o.DECIDED, _policy_sql(INLINE_SQL))
def inline_policy(spark, sf):
    return _flat(policy.count_policy(_decision_rows(spark, sf), INLINE_POLICY), "reasons")


# Fixed values in the SQL: the wording of the advice.
@query(
    "recommendation",
    *o.DECIDED,
    f"""SELECT scenario, status, CASE status
      WHEN 'RETRAIN' THEN 'Retraining is recommended for ' || scenario || '. The model shows meaningful degradation and/or drift beyond threshold.'
      WHEN 'WARNING' THEN scenario || ' should be monitored closely. Retraining is not urgent yet, but warning thresholds were exceeded.'
      ELSE scenario || ' is currently stable. No immediate retraining is required.' END AS recommendation
    FROM (SELECT scenario, {COUNT_SQL['status']} AS status FROM rows)""",
)
def recommend(spark, sf):
    decided = policy.count_policy(_decision_rows(spark, sf), COUNT_POLICY)
    return policy.with_recommendation(decided).select("scenario", "status", "recommendation")


# The wording of the advice.
INLINE_ADVICE_SQL = """CASE status
      WHEN 'RETRAIN' THEN 'Retraining is recommended based on drift and/or performance degradation.'
      WHEN 'WARNING' THEN 'Monitor closely. Performance is degrading but has not yet crossed retrain threshold.'
      ELSE 'Model is stable. No action required.' END"""


@query(
    "recommendation_inline",
    *o.DECIDED,
    f"SELECT scenario, status, {INLINE_ADVICE_SQL} AS recommendation FROM (SELECT scenario, {INLINE_SQL['status']} AS status FROM rows)",
)
def recommend_inline(spark, sf):
    decided = policy.count_policy(_decision_rows(spark, sf), INLINE_POLICY)
    return policy.with_recommendation(decided, policy.INLINE_RECOMMENDATIONS).select("scenario", "status", "recommendation")


RATIO_COLUMNS = f"scenario, n_drifted, {o.rs('drift_share', 'f1_score', 'auc_roc')}, retrain"


@query("policy_ratio", *o.DECIDED, o.OBS_RATIO, f"SELECT {RATIO_COLUMNS}, reasons, alerts FROM ratio_decided")
def ratio(spark, sf):
    return _flat(policy.ratio_policy(_decision_rows(spark, sf), SPEC, RATIO_POLICY), "reasons", "alerts")


@query("batch_check", *o.DECIDED, o.OBS_RATIO, f"SELECT {RATIO_COLUMNS} FROM ratio_decided")
def check(spark, sf):
    """The automated check as one call, retraining share limit and drops at their defaults."""
    return rounded(monitoring.batch_check(obs(spark, sf), SPEC, RATIO_POLICY).drop("reasons", "alerts"))


HEALTH_SQL = """CASE WHEN NOT retrain AND drift_share = 0 THEN 'green'
    WHEN NOT retrain AND drift_share < 3e-1 THEN 'yellow' ELSE 'red' END AS health"""


@query("health_label", *o.DECIDED, o.OBS_RATIO, f"SELECT scenario, {o.rs('drift_share')}, retrain, {HEALTH_SQL} FROM ratio_decided")
def health(spark, sf):
    decided = policy.ratio_policy(_decision_rows(spark, sf), SPEC, RATIO_POLICY)
    colour = policy.health_label(F.col("drift_share"), F.col("retrain"), RATIO_POLICY.share)
    return rounded(decided.select("scenario", "drift_share", "retrain", colour.alias("health")))


@query(
    "model_health",
    *o.DECIDED,
    o.OBS_RATIO,
    o.PSI,
    f"""SELECT r.scenario, n_drifted, {o.rs('drift_share', 'avg_psi', 'f1_score', 'auc_roc')}, retrain, {HEALTH_SQL}, reasons
    FROM ratio_decided r LEFT JOIN avgpsi a ON a.scenario = r.scenario""",
)
def full_health(spark, sf):
    return rounded(monitoring.model_health(obs(spark, sf), SPEC, RATIO_POLICY))


# Fixed values in the SQL: the wording of the limits.
@query(
    "threshold_table",
    *o.DECIDED,
    o.PSI,
    """SELECT 'KS p-value' AS metric, '< 0.05' AS threshold, 'Feature drifted' AS action,
      (SELECT count(*) FILTER (WHERE p_value < 5e-2) FROM tests) AS n_passed
    UNION ALL SELECT 'PSI moderate', '> 0.1', 'Watch closely', (SELECT count(*) FILTER (WHERE psi > 1e-1) FROM psis)
    UNION ALL SELECT 'PSI high', '> 0.2', 'Trigger retrain', (SELECT count(*) FILTER (WHERE psi > 2e-1) FROM psis)
    UNION ALL SELECT '% features drifted', '> 30%', 'Trigger retrain', (SELECT count(*) FILTER (WHERE n_drifted / 4e0 > 3e-1) FROM rows)
    UNION ALL SELECT 'F1 drop', '> 0.05', 'Trigger retrain', (SELECT count(*) FILTER (WHERE f1_drop > 5e-2) FROM rows)
    UNION ALL SELECT 'AUC-ROC drop', '> 0.03', 'Trigger retrain', (SELECT count(*) FILTER (WHERE auc_drop > 3e-2) FROM rows)""",
)
def thresholds(spark, sf):
    """The limits in force, each with the number of cases that pass it."""
    table_ = obs(spark, sf)
    layout = monitoring.survey(table_, SPEC)
    tests = stored(drift.ks_test(table_, SPEC, layout=layout))
    metrics = evaluate.evaluate(table_, SPEC, layout)
    rows = stored(policy.decision_rows(metrics, drift.drift_share(tests, SPEC), SPEC))
    indices = stored(psi.psi_table(table_, SPEC, edges=monitoring.feature_edges(layout, SPEC)))
    return policy.threshold_usage(rows, tests, indices, SPEC, RATIO_POLICY)


SECOND = """
two AS (SELECT *, (qty + 5e0 * l_linenumber) / 1.01e2 AS Probability2,
  CASE WHEN (qty + 5e0 * l_linenumber) / 1.01e2 > 6e-1 THEN 1 ELSE 0 END AS Prediction2 FROM obs)
"""


@query(
    "champion_challenger",
    *o.OBS,
    o.EVAL,
    SECOND,
    o.evaluation("Probability2", "Prediction2", "2").replace("FROM obs", "FROM two"),
    f"""SELECT c.scenario, {o.r('champion_f1', 'c.f1_score')}, {o.r('champion_auc', 'c.auc_roc')},
    {o.r('challenger_f1', 'n.f1_score')}, {o.r('challenger_auc', 'n.auc_roc')},
    {o.r('f1_gain', 'n.f1_score - c.f1_score')}, {o.r('auc_gain', 'n.auc_roc - c.auc_roc')},
    coalesce(n.f1_score - c.f1_score >= 1e-2 AND n.auc_roc - c.auc_roc >= 0, false) AS promote
    FROM metrics c JOIN metrics2 n ON n.scenario = c.scenario""",
)
def gate(spark, sf):
    """Both models evaluated over one pass of the rows."""
    models = {"champion": ("Probability", "Prediction"), "challenger": ("Probability2", "Prediction2")}
    return rounded(policy.champion_challenger(evaluate.evaluate_models(obs_two_scores(spark, sf), SPEC, models)))


# ------------------------------------------------------------- preparation

SPLIT_HASH = o.row_hash_sql(KEYS)


SPLIT_CTES = f"""hashed AS (SELECT *, {SPLIT_HASH} AS h FROM obs WHERE scenario = 'Baseline'),
    sizes AS (SELECT Class, count(*) AS n FROM hashed GROUP BY Class),
    total AS (SELECT CAST(ceil(4e-1 * sum(n)) AS BIGINT) AS out_n, CAST(sum(n) AS BIGINT) AS n FROM sizes),
    first_cut AS (
      SELECT Class, s.n, out_n, floor(out_n * s.n / CAST(t.n AS DOUBLE)) AS low,
        row_number() OVER (ORDER BY floor(out_n * s.n / CAST(t.n AS DOUBLE)) - out_n * s.n / CAST(t.n AS DOUBLE), Class) AS k,
        sum(floor(out_n * s.n / CAST(t.n AS DOUBLE))) OVER () AS given
      FROM sizes s CROSS JOIN total t),
    held AS (SELECT Class, n, CAST(low + CASE WHEN k <= out_n - given THEN 1 ELSE 0 END AS BIGINT) AS out_c, out_n FROM first_cut),
    second_cut AS (
      SELECT *, ceil(5e-1 * out_n) AS test_n, floor(ceil(5e-1 * out_n) * out_c / CAST(out_n AS DOUBLE)) AS low,
        row_number() OVER (ORDER BY floor(ceil(5e-1 * out_n) * out_c / CAST(out_n AS DOUBLE))
          - ceil(5e-1 * out_n) * out_c / CAST(out_n AS DOUBLE), Class) AS k,
        sum(floor(ceil(5e-1 * out_n) * out_c / CAST(out_n AS DOUBLE))) OVER () AS given FROM held),
    quotas AS (SELECT Class, n - out_c AS train_c,
      n - CAST(low + CASE WHEN k <= test_n - given THEN 1 ELSE 0 END AS BIGINT) AS upto_val FROM second_cut),
    placed AS (SELECT h.*, row_number() OVER (PARTITION BY h.Class ORDER BY h, {', '.join(KEYS)}) AS place FROM hashed h)"""

@query(
    "strat_split",
    *o.OBS,
    SPLIT_CTES,
    """SELECT p.Class, CASE WHEN place <= train_c THEN 'train' WHEN place <= upto_val THEN 'val' ELSE 'test' END AS split,
      count(*) AS n, CAST(sum(h) AS BIGINT) AS sum_hash, CAST(sum(l_orderkey) AS BIGINT) AS sum_key
    FROM placed p JOIN quotas q ON q.Class = p.Class GROUP BY 1, 2""",
)
def split(spark, sf):
    base = obs(spark, sf).filter(F.col("scenario") == "Baseline")
    parts = prepare.stratified_split(base, "Class", KEYS)
    return parts.groupBy("Class", "split").agg(
        F.count("*").alias("n"), F.sum(prepare.row_hash(KEYS)).alias("sum_hash"), F.sum("l_orderkey").alias("sum_key")
    )


@query(
    "hash_split",
    *o.OBS,
    f"""SELECT CASE WHEN {SPLIT_HASH} / 4294967296e0 < 6e-1 THEN 'train' WHEN {SPLIT_HASH} / 4294967296e0 < 8e-1 THEN 'val' ELSE 'test' END AS split,
      scenario, count(*) AS n FROM obs GROUP BY 1, 2""",
)
def cheap_split(spark, sf):
    return prepare.hash_split(obs(spark, sf), KEYS).groupBy("split", "scenario").agg(F.count("*").alias("n"))


@query(
    "standardize",
    *o.OBS,
    "fitted AS (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0e0), 1e0) AS s_{f}" for f in FEATURES)
    + " FROM obs WHERE scenario = 'Baseline')",
    "SELECT scenario, l_orderkey, l_linenumber, "
    + ", ".join(o.r(f, f"({f} - m_{f}) / s_{f}") for f in FEATURES)
    + " FROM obs CROSS JOIN fitted",
)
def scaled(spark, sf):
    """Every row scaled by the baseline's mean and deviation."""
    table_ = obs(spark, sf)
    scaler = prepare.fit_scaler(table_.filter(F.col("scenario") == "Baseline"), FEATURES)
    return rounded(prepare.standardize(table_, scaler).select("scenario", "l_orderkey", "l_linenumber", *FEATURES))


@query(
    "retrain_set",
    *o.OBS,
    f"""SELECT 'recent' AS origin, scenario, l_orderkey, l_linenumber, qty FROM obs WHERE scenario <> 'Baseline' AND
      l_shipdate > (SELECT max(l_shipdate) FROM obs WHERE scenario <> 'Baseline') - INTERVAL 90 DAY
    UNION ALL SELECT 'original', scenario, l_orderkey, l_linenumber, qty FROM obs
      WHERE scenario = 'Baseline' AND {SPLIT_HASH} < {int(0.3 * 4294967296)}""",
)
def retrain(spark, sf):
    return prepare.retraining_set(obs(spark, sf), SPEC, 90, KEYS).select(
        "origin", "scenario", "l_orderkey", "l_linenumber", "qty"
    )


# ----------------------------------------------------------------- reports
# Each report is written as JSON, read back and laid flat again.


def _through_json(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    write_json(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


@query(
    "report_baseline",
    *EVALUATED,
    f"""SELECT 'lineitem' AS dataset, 'threshold rule' AS baseline_model, n_rows AS test_set_size,
    {o.rs(*evaluate.METRICS)}, concat_ws(',', tn, fp, fn, tp) AS matrix, tn + fp AS n_negative, fn + tp AS n_positive
    FROM metrics WHERE scenario = 'Baseline'""",
)
def report_baseline(spark, sf):
    report = reports.baseline_report(evaluate.evaluate(obs(spark, sf), SPEC), SPEC, "lineitem", "threshold rule")
    back = _through_json(report)
    return rounded(
        back.select(
            "dataset",
            "baseline_model",
            "test_set_size",
            "metrics.*",
            F.concat_ws(",", F.flatten("confusion_matrix").cast("array<string>")).alias("matrix"),
            F.col("class_distribution.legitimate").alias("n_negative"),
            F.col("class_distribution.fraud").alias("n_positive"),
        )
    )


@query(
    "report_distribution",
    *TABLE,
    f"""SELECT t.scenario, t.feature, {o.r('ks_statistic')}, {o.r('ks_pvalue', 'p_value')},
    {o.rs('cohens_d', 'mean_diff', 'std_diff')} FROM {JOINED}""",
)
def report_distribution(spark, sf):
    back = _through_json(reports.distribution_report(drift.drift_table(obs(spark, sf), SPEC)))
    return rounded(back.select("scenario", F.explode("ks_tests").alias("feature", "t")).select("scenario", "feature", "t.*"))


@query(
    "report_impact",
    *COMPARISON,
    f"""SELECT 'threshold rule' AS model, {o.r('base_f1', 'base_f1_score')}, scenario, n_rows AS n_samples,
    {o.r('fraud_rate', 'positive_rate')}, {o.rs('f1_score', 'auc_roc', 'delta_f1_score', 'delta_auc_roc')}
    FROM compared WHERE scenario <> 'Baseline'""",
)
def report_impact(spark, sf):
    back = _through_json(reports.impact_report(_compared(spark, sf), SPEC, "threshold rule"))
    one = back.select("baseline", F.inline("drift_scenarios"))
    return rounded(
        one.select(
            "baseline.model",
            F.col("baseline.metrics.f1_score").alias("base_f1"),
            "scenario",
            "n_samples",
            "fraud_rate",
            "metrics.f1_score",
            "metrics.auc_roc",
            F.col("deltas.f1_score").alias("delta_f1_score"),
            F.col("deltas.auc_roc").alias("delta_auc_roc"),
        )
    )


@query(
    "report_monitoring",
    *o.DECIDED,
    o.OBS_RATIO,
    o.PSI,
    f"""SELECT r.scenario, 'monitoring_' || lower(replace(r.scenario, ' ', '_')) || '.json' AS file_name,
    {o.r('drift_pct', 'drift_share * 1e2', 1)}, n_drifted, {o.r('avg_psi', 'avg_psi', 4)}, {o.r('f1', 'f1_score', 4)},
    {o.r('auc_roc', 'auc_roc', 4)}, retrain, reasons, 5e-2 AS ks_alpha, 3e-1 AS drift_pct_trigger
    FROM ratio_decided r LEFT JOIN avgpsi a ON a.scenario = r.scenario""",
)
def report_monitoring(spark, sf):
    table_ = obs(spark, sf)
    layout = monitoring.survey(table_, SPEC)
    averages = psi.psi_average(psi.psi_table(table_, SPEC, edges=monitoring.feature_edges(layout, SPEC)))
    decided = monitoring.batch_check(table_, SPEC, RATIO_POLICY, layout)
    text = reports.monitoring_report(decided, averages, RATIO_POLICY)
    schema = """scenario string, drift_pct double, n_drifted long, avg_psi double, f1 double, auc_roc double,
        retrain boolean, reasons array<string>, thresholds struct<ks_alpha: double, drift_pct_trigger: double>"""
    back = text.select("file_name", F.from_json("report", schema).alias("r"))
    flat = back.select("file_name", "r.*").withColumn("reasons", F.concat_ws("; ", "reasons"))
    return rounded(flat.select("*", "thresholds.*").drop("thresholds"))


from shiftspark.plans import catalog_models, catalog_streams  # noqa: E402, F401
