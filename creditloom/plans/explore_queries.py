"""Exploration queries over the application table."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.functions.nulls import rounded
from creditloom.operators import explore
from creditloom.operators.clean import UNKNOWN_EMPLOYMENT
from creditloom.operators.encode import baseline_means as mean_row
from creditloom.operators.sampling import sample_fraction, sample_rows
from creditloom.plans.registry import query, r6, with_views
from creditloom.sources.views import VIEWS, view

APP = ["application_train"]
MONEY = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"]


def _app(spark, sf_dir):
    return view(spark, sf_dir, "application_train")


def _union(parts):
    return " union all ".join(parts)


@query(
    "G01",
    with_views(
        APP,
        "select TARGET, count(*) as count, round_even(count(*)*100e0/(select count(*) from application_train), 2)"
        " as percentage from application_train group by TARGET",
    ),
)
def target_distribution(spark, sf_dir):
    return explore.value_counts(_app(spark, sf_dir), "TARGET")


_APP_COLUMNS = [c for c, _ in VIEWS["application_train"].columns]


@query(
    "G02",
    with_views(
        APP,
        'select "column", null_count, round_even(null_count*100e0/n, 2) as null_pct from ('
        + _union(
            f"select '{c}' as \"column\", count(*)-count({c}) as null_count, count(*) as n from application_train"
            for c in _APP_COLUMNS
        )
        + ")",
    ),
)
def missing_values(spark, sf_dir):
    return explore.missing_profile(_app(spark, sf_dir))


@query(
    "G03",
    with_views(
        APP,
        _union(
            f"select '{c}' as \"column\", count({c}) as count, {r6(f'avg({c})', 'mean')},"
            f" {r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', 'min')}, {r6(f'quantile_cont({c}, 0.25)', 'p25')},"
            f" {r6(f'median({c})', 'p50')}, {r6(f'quantile_cont({c}, 0.75)', 'p75')}, {r6(f'max({c})', 'max')}"
            " from application_train"
            for c in MONEY
        ),
    ),
)
def money_description(spark, sf_dir):
    return rounded(explore.describe(_app(spark, sf_dir), MONEY))


UNIVARIATE = [*MONEY, "DAYS_BIRTH"]


@query(
    "G04",
    with_views(
        APP,
        _union(
            f"select '{c}' as \"column\", {r6(f'avg({c})', 'mean')}, {r6(f'median({c})', 'median')},"
            f" {r6(f'floor(var_samp({c})*1e2+5e-1)/1e2', 'variance')}, {r6(f'stddev_samp({c})', 'std')} from application_train"
            for c in UNIVARIATE
        ),
    ),
)
def univariate_moments(spark, sf_dir):
    df = explore.moments(_app(spark, sf_dir), UNIVARIATE)
    cents = F.floor(F.col("variance") * 100.0 + 0.5) / 100.0
    return rounded(df.withColumn("variance", cents))


@query(
    "G05",
    with_views(APP, "select CODE_GENDER, count(*) as count from application_train group by CODE_GENDER"),
)
def gender_frequency(spark, sf_dir):
    return explore.frequency_order(_app(spark, sf_dir), "CODE_GENDER")


@query(
    "G06",
    with_views(
        APP,
        "select coalesce(DAYS_EMPLOYED=365243, false) as unknown_employment, count(*) as count"
        " from application_train group by 1",
    ),
)
def employment_sentinel(spark, sf_dir):
    df = _app(spark, sf_dir)
    return explore.count_by_condition(df, F.col("DAYS_EMPLOYED") == UNKNOWN_EMPLOYMENT, "unknown_employment")


@query(
    "G07",
    with_views(
        APP,
        f"select TARGET, {r6('avg(AMT_INCOME_TOTAL)', 'avg_AMT_INCOME_TOTAL')},"
        f" {r6('avg(AMT_CREDIT)', 'avg_AMT_CREDIT')} from application_train group by TARGET",
    ),
)
def means_by_target(spark, sf_dir):
    return rounded(explore.means_by(_app(spark, sf_dir), ["TARGET"], ["AMT_INCOME_TOTAL", "AMT_CREDIT"]))


@query(
    "G07",
    with_views(
        APP, "select CODE_GENDER, TARGET, count(*) as count from application_train group by CODE_GENDER, TARGET"
    ),
)
def gender_target_counts(spark, sf_dir):
    return explore.counts_by(_app(spark, sf_dir), ["CODE_GENDER", "TARGET"])


@query(
    "G08",
    with_views(
        APP,
        f"select NAME_INCOME_TYPE, {r6('avg(AMT_INCOME_TOTAL)', 'avg_AMT_INCOME_TOTAL')},"
        f" {r6('avg(TARGET)', 'avg_TARGET')} from application_train where NAME_INCOME_TYPE is not null"
        " group by NAME_INCOME_TYPE",
    ),
)
def income_type_means(spark, sf_dir):
    return rounded(explore.means_by(_app(spark, sf_dir), ["NAME_INCOME_TYPE"], ["AMT_INCOME_TOTAL", "TARGET"]))


@query(
    "G09",
    with_views(
        APP,
        "select NAME_EDUCATION_TYPE, count(*) filter (where TARGET=0) as TARGET_0,"
        " count(*) filter (where TARGET=1) as TARGET_1 from application_train group by NAME_EDUCATION_TYPE",
    ),
)
def education_crosstab(spark, sf_dir):
    return explore.crosstab(_app(spark, sf_dir), "NAME_EDUCATION_TYPE", "TARGET", [0, 1])


CORRELATED = [*MONEY, "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


@query(
    "G10",
    with_views(
        APP,
        _union(
            f"select '{c}' as feature, {r6(f'corr({c}, TARGET)', 'corr')} from application_train" for c in CORRELATED
        ),
    ),
)
def target_correlations(spark, sf_dir):
    return rounded(explore.correlations_with(_app(spark, sf_dir), CORRELATED, "TARGET"))


@query(
    "M06",
    with_views(
        APP,
        f"select feature, {r6('corr')} from ("
        + _union(f"select '{c}' as feature, corr({c}, TARGET) as corr from application_train" for c in CORRELATED)
        + ") where abs(corr) >= 2e-2",
    ),
)
def selected_by_correlation(spark, sf_dir):
    from creditloom.operators.selection import select_by_correlation

    return rounded(select_by_correlation(_app(spark, sf_dir), CORRELATED, "TARGET"))


MATRIX = ["TARGET", *MONEY, "EXT_SOURCE_2", "EXT_SOURCE_3", "EXT_SOURCE_1", "DAYS_BIRTH", "DAYS_EMPLOYED"]


@query(
    "G11",
    with_views(
        APP,
        _union(
            f"select '{a}' as feature_x, '{b}' as feature_y, {r6(f'corr({a}, {b})', 'corr')} from application_train"
            for a in MATRIX
            for b in MATRIX
        ),
    ),
)
def feature_correlation_matrix(spark, sf_dir):
    return rounded(explore.correlation_matrix(_app(spark, sf_dir), MATRIX))


STATS = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_EMPLOYED", "AMT_CREDIT", "AMT_ANNUITY", "NOT_A_COLUMN"]


@query(
    "G12",
    with_views(
        APP,
        _union(
            [
                f"select '{c}' as feature, true as found, {r6(f'min({c})', 'min')}, {r6(f'max({c})', 'max')},"
                f" {r6(f'avg({c})', 'mean')}, {r6(f'median({c})', 'median')} from application_train"
                for c in STATS[:-1]
            ]
            + [
                "select 'NOT_A_COLUMN', false, cast(null as double), cast(null as double), cast(null as double),"
                " cast(null as double)"
            ]
        ),
    ),
)
def named_feature_stats(spark, sf_dir):
    return rounded(explore.feature_stats(_app(spark, sf_dir), STATS))


NUMERIC = [c for c in _APP_COLUMNS if not c.startswith(("CODE", "NAME", "SK_", "TARGET"))]


@query("G13", with_views(APP, f"select {', '.join(r6(f'avg({c})', c) for c in NUMERIC)} from application_train"))
def baseline_means(spark, sf_dir):
    return rounded(mean_row(_app(spark, sf_dir), NUMERIC))


@query(
    "G14",
    with_views(
        APP,
        f"""select cast(k as int) as bin, {r6('lo+k*w', 'bin_start')}, {r6('lo+(k+1)*w', 'bin_end')},
 count(AMT_INCOME_TOTAL) as count from range(10) t(k), e left join application_train
 on cast(least(floor((AMT_INCOME_TOTAL-lo)/w), 9) as int)=k group by k, lo, w""",
        [
            """e as (select min(AMT_INCOME_TOTAL) as lo, (max(AMT_INCOME_TOTAL)-min(AMT_INCOME_TOTAL))/10 as w
 from application_train)"""
        ],
    ),
)
def income_histogram(spark, sf_dir):
    return rounded(explore.histogram(_app(spark, sf_dir), "AMT_INCOME_TOTAL"))


@query(
    "G15",
    with_views(
        APP,
        "select count(*) filter (where TARGET=0) as negatives, count(*) filter (where TARGET=1) as positives, "
        + r6("count(*) filter (where TARGET=0)/count(*) filter (where TARGET=1)", "ratio")
        + " from application_train",
    ),
)
def class_balance(spark, sf_dir):
    return rounded(explore.class_ratio(_app(spark, sf_dir)))


HASH = "('0x' || substr(md5('split:' || SK_ID_CURR), 1, 10))::bigint"


@query(
    "C12",
    with_views(
        APP, f"select SK_ID_CURR, AMT_INCOME_TOTAL from application_train where ({HASH}) % 1000000 < 300000"
    ),
)
def sampled_fraction(spark, sf_dir):
    return sample_fraction(_app(spark, sf_dir).select("SK_ID_CURR", "AMT_INCOME_TOTAL"), 0.3)


@query(
    "C12",
    with_views(
        APP, f"select SK_ID_CURR, AMT_INCOME_TOTAL from application_train order by {HASH}, SK_ID_CURR limit 1000"
    ),
)
def sampled_rows(spark, sf_dir):
    return sample_rows(_app(spark, sf_dir).select("SK_ID_CURR", "AMT_INCOME_TOTAL"), 1000)


IMPORTANCE_CTES = [
    "imp as ("
    + _union(
        f"select '{c}' as feature, abs(corr({c}, TARGET)) as importance from application_train" for c in CORRELATED
    )
    + ")",
    """cum as (select feature, importance, row_number() over w as rank,
 sum(importance) over (w rows between unbounded preceding and current row)/sum(importance) over () as cumulative
 from imp window w as (order by importance desc, feature))""",
]


@query(
    "W04",
    with_views(
        APP,
        f"select feature, {r6('importance')}, rank, {r6('cumulative')},"
        " round(cumulative, 9) <= 9e-1 as selected from cum",
        IMPORTANCE_CTES,
    ),
)
def importance_share(spark, sf_dir):
    corr = explore.correlations_with(_app(spark, sf_dir), CORRELATED, "TARGET")
    table = corr.select("feature", F.abs("corr").alias("importance"))
    return rounded(explore.cumulative_importance(table).withColumn("rank", F.col("rank").cast("long")))
