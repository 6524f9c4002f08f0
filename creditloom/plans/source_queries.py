"""Sources, sinks, encoding, alignment and what-if queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creditloom.functions.nulls import rounded
from creditloom.operators import encode, evaluate, explain
from creditloom.operators.clean import candidate_columns, drop_empty_and_impute, flag_unknown_employment
from creditloom.plans.evaluate_queries import CONF_CTE
from creditloom.plans.explain_queries import COEFFICIENT_SQL, COEFFICIENTS, FEATURES, INTERCEPT
from creditloom.plans.feature_queries import FLAGGED_CTE
from creditloom.plans.registry import query, r6, with_views
from creditloom.session import scratch_path
from creditloom.sources import tables
from creditloom.sources.views import VIEWS, view

APP = ["application_train"]
PREV_SCHEMA = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, AMT_APPLICATION double, AMT_CREDIT double,"
    " NAME_CONTRACT_STATUS string, DAYS_DECISION int"
)
PREV_TYPES = {c.split()[0]: c.split()[1] for c in PREV_SCHEMA.split(", ")}


def _csv(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).csv(path)
    return path


@query("S01", with_views(["previous_application"], "select * from previous_application"))
def csv_source(spark, sf_dir):
    """The previous applications written as CSV and read back with their schema."""
    path = _csv(view(spark, sf_dir, "previous_application"), "csv-source")
    return tables.read_csv(spark, path, PREV_SCHEMA)


@query(
    "S02",
    with_views(
        ["previous_application"], "select SK_ID_CURR, AMT_CREDIT, DAYS_DECISION from previous_application"
    ),
)
def csv_wanted_columns(spark, sf_dir):
    path = _csv(view(spark, sf_dir, "previous_application"), "csv-wanted")
    wanted = ["SK_ID_CURR", "AMT_CREDIT", "DAYS_DECISION", "NOT_IN_THE_FILE"]
    return tables.read_wanted(spark, path, wanted, PREV_TYPES)


@query(
    "S03",
    with_views(APP, "select SK_ID_CURR as id, AMT_CREDIT, EXT_SOURCE_2 from application_train"),
)
def batch_with_id_column(spark, sf_dir):
    """The id column is found whatever its case."""
    upload = view(spark, sf_dir, "application_train").select(
        "AMT_CREDIT", F.col("SK_ID_CURR").alias("Sk_Id_Curr"), "EXT_SOURCE_2"
    )
    return tables.read_batch(spark, _csv(upload, "batch-id"), "AMT_CREDIT double, Sk_Id_Curr bigint, EXT_SOURCE_2 double")


@query(
    "S03",
    with_views(
        APP,
        "select row_number() over (order by SK_ID_CURR)-1 as id, AMT_CREDIT, EXT_SOURCE_2 from application_train",
    ),
)
def batch_by_row_position(spark, sf_dir):
    """Without an id column the position in the files is the id."""
    upload = view(spark, sf_dir, "application_train").orderBy("SK_ID_CURR").select("AMT_CREDIT", "EXT_SOURCE_2")
    return tables.read_batch(spark, _csv(upload, "batch-position"), "AMT_CREDIT double, EXT_SOURCE_2 double")


SHAPED = ["application_train", "bureau", "previous_application", "installments_payments"]


@query(
    "S04",
    with_views(
        SHAPED,
        " union all ".join(
            f"select '{v}' as \"table\", count(*) as rows, {len(VIEWS[v].columns)} as columns from {v}" for v in SHAPED
        ),
    ),
)
def source_shapes(spark, sf_dir):
    return tables.table_shapes({v: view(spark, sf_dir, v) for v in SHAPED})


@query(
    "S05, S06, S09",
    with_views(
        [*APP, "cohort"],
        "select SK_ID_CURR, AMT_CREDIT, EXT_SOURCE_2 from application_train where SK_ID_CURR in"
        " (select applicant_id from cohort where target=1)",
    ),
)
def parquet_subset(spark, sf_dir):
    """A table written by hash bucket, appended to, and read by column and id list."""
    path = scratch_path(spark, "applicants")
    app = view(spark, sf_dir, "application_train")
    tables.create_and_append(app.where("SK_ID_CURR % 2 = 0"), path, "SK_ID_CURR", buckets=4)
    tables.create_and_append(app.where("SK_ID_CURR % 2 <> 0"), path, "SK_ID_CURR", buckets=4)
    ids = view(spark, sf_dir, "cohort").where("target = 1").select(F.col("applicant_id").alias("SK_ID_CURR"))
    return tables.read_parquet_rows(spark, path, ["SK_ID_CURR", "AMT_CREDIT", "EXT_SOURCE_2"], ids, "SK_ID_CURR")


_INTS = ["SK_ID_CURR", "TARGET", "DAYS_EMPLOYED", "DAYS_BIRTH", "DAYS_REGISTRATION", "DAYS_LAST_PHONE_CHANGE"]
_INTS += ["CNT_CHILDREN", "CNT_FAM_MEMBERS"]
_DBLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "OWN_CAR_AGE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


@query(
    "S07",
    with_views(
        APP,
        """select "column", t as narrow_type, case t when 'u8' then 'short' when 'u16' then 'int' when 'u32' then 'long' when 'u64' then 'long'
 when 'i8' then 'byte' when 'i16' then 'short' when 'i32' then 'int' when 'i64' then 'long' else 'float' end as spark_type from (
 select "column", case when lo>=0 then case when hi<255 then 'u8' when hi<65535 then 'u16' when hi<4294967295 then 'u32' else 'u64' end
 when lo>-128 and hi<127 then 'i8' when lo>-32768 and hi<32767 then 'i16'
 when lo>-2147483648 and hi<2147483647 then 'i32' else 'i64' end as t from rng
 union all select unnest([%s]), 'f32')""" % ", ".join(f"'{c}'" for c in _DBLS),
        [
            "rng as ("
            + " union all ".join(
                f"select '{c}' as \"column\", min({c}) as lo, max({c}) as hi from application_train" for c in _INTS
            )
            + ")"
        ],
    ),
)
def narrowed_types(spark, sf_dir):
    return tables.narrow_report(view(spark, sf_dir, "application_train"))


_METRICS = f"select tp, fp, tn, fn, {', '.join(r6(c) for c in ('accuracy', 'precision', 'recall', 'f1'))} from metrics"


@query(
    "S08",
    with_views(
        ["scored"],
        f"{_METRICS} union all {_METRICS}",
        [
            CONF_CTE,
            """metrics as (select *, (tp+tn)/(tp+fp+tn+fn) as accuracy, tp/(tp+fp) as precision, tp/(tp+fn) as recall,
 2*tp/(2*tp+fp+fn) as f1 from conf)""",
        ],
    ),
)
def metrics_files(spark, sf_dir):
    """A metrics table through the small JSON and CSV sinks and back."""
    metrics = evaluate.confusion(view(spark, sf_dir, "scored"), 0.15)
    json_path, csv_path = scratch_path(spark, "metrics-json"), scratch_path(spark, "metrics-csv")
    tables.write_small_json(metrics, json_path)
    tables.write_small_csv(metrics, csv_path)
    from_csv = spark.read.schema(metrics.schema).option("header", True).csv(csv_path)
    return rounded(spark.read.schema(metrics.schema).json(json_path).unionByName(from_csv))


_BIN = "cast(" + "+".join(f"(case when p>{k}e-1 then 1 else 0 end)" for k in range(1, 10)) + " as int)"


@query(
    "S13",
    with_views(
        ["scored"],
        f"""select stage, cast(row_number() over (partition by stage order by bin)-1 as int) as point,
 {r6('mean_predicted')}, {r6('actual_default_rate')} from curve""",
        [
            "doubled as (select id, p*2 as p, y from scored)",
            f"""curve as (select 'before' as stage, {_BIN} as bin, avg(p) as mean_predicted, avg(y) as actual_default_rate
 from scored group by 2 union all select 'after', {_BIN}, avg(p), avg(y) from doubled group by 2)""",
        ],
    ),
)
def stored_calibration(spark, sf_dir):
    """Two curves stored as one JSON document and read back as rows."""
    scored = view(spark, sf_dir, "scored")
    stages = {"before": scored, "after": scored.withColumn("p", F.col("p") * 2)}
    path = scratch_path(spark, "calibration")
    document = tables.calibration_document(
        {s: evaluate.calibration_curve(df) for s, df in stages.items()},
        {s: evaluate.brier_score(df) for s, df in stages.items()},
    )
    tables.write_small_json(document, path)
    return rounded(tables.read_calibration(spark, path))


# --- encoding and alignment ---------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "C06, C07",
    with_views(
        APP,
        "select SK_ID_CURR, "
        + ", ".join(f"case when CODE_GENDER='{g}' then 1 else 0 end as CODE_GENDER_{g}" for g in "FM")
        + ", case when CODE_GENDER is null then 1 else 0 end as CODE_GENDER_nan, "
        + ", ".join(
            f"case when NAME_INCOME_TYPE='{s}' then 1 else 0 end as NAME_INCOME_TYPE_{s}" for s in _SEGMENTS
        )
        + ", case when NAME_INCOME_TYPE is null then 1 else 0 end as NAME_INCOME_TYPE_nan from application_train",
    ),
)
def one_hot_columns(spark, sf_dir):
    df = view(spark, sf_dir, "application_train").select("SK_ID_CURR", "CODE_GENDER", "NAME_INCOME_TYPE")
    return encode.one_hot(df)


ALIGNED = ["EXT_SOURCE_2", "AMT_CREDIT", "NAME_INCOME_TYPE_nan", "ORGANIZATION_TYPE_School", "CODE_GENDER_M"]


@query(
    "C08, U03",
    with_views(
        APP,
        "select SK_ID_CURR, EXT_SOURCE_2, AMT_CREDIT, case when NAME_INCOME_TYPE is null then 1 else 0 end as"
        " NAME_INCOME_TYPE_nan, 0 as ORGANIZATION_TYPE_School, case when CODE_GENDER='M' then 1 else 0 end as"
        " CODE_GENDER_M from application_train",
    ),
)
def aligned_features(spark, sf_dir):
    return encode.align_to(encode.one_hot(view(spark, sf_dir, "application_train")), ALIGNED, keep=["SK_ID_CURR"])


_FLAGS = "CODE_GENDER='M' as IS_MALE, CODE_GENDER='F' as IS_FEMALE"
_TRAINED = f"trained as (select *, {_FLAGS} from application_train)"


def _baseline_sql(male, female):
    return with_views(
        APP,
        f"""select SK_ID_CURR, {r6('coalesce(EXT_SOURCE_1, (select avg(EXT_SOURCE_1) from trained))', 'EXT_SOURCE_1')},
 {r6('coalesce(EXT_SOURCE_2, (select avg(EXT_SOURCE_2) from trained))', 'EXT_SOURCE_2')},
 coalesce(CNT_FAM_MEMBERS, (select cast(floor(avg(CNT_FAM_MEMBERS)) as bigint) from trained)) as CNT_FAM_MEMBERS,
 {r6('(select avg(AMT_CREDIT) from trained)', 'AMT_CREDIT')},
 (select {male} from trained) as IS_MALE, (select {female} from trained) as IS_FEMALE from trained""",
        [_TRAINED],
    )


def _batch_aligned(spark, sf_dir, mode):
    app = view(spark, sf_dir, "application_train")
    trained = app.withColumns({"IS_MALE": F.col("CODE_GENDER") == "M", "IS_FEMALE": F.col("CODE_GENDER") == "F"})
    columns = ["EXT_SOURCE_1", "EXT_SOURCE_2", "CNT_FAM_MEMBERS", "AMT_CREDIT", "IS_MALE", "IS_FEMALE"]
    baseline = encode.fit_baseline(trained, columns)
    batch = app.select("SK_ID_CURR", "EXT_SOURCE_2", "CNT_FAM_MEMBERS", "EXT_SOURCE_1")
    return rounded(encode.align_with_baseline(batch, baseline, keep=["SK_ID_CURR"], mode=mode))


@query(
    "C09",
    _baseline_sql(
        "avg(case when IS_MALE then 1 else 0 end)>=5e-1", "avg(case when IS_FEMALE then 1 else 0 end)>=5e-1"
    ),
)
def baseline_aligned(spark, sf_dir):
    return _batch_aligned(spark, sf_dir, "safe")


@query(
    "C09",
    _baseline_sql("avg(case when IS_MALE then 1 else 0 end)<>0", "avg(case when IS_FEMALE then 1 else 0 end)<>0"),
)
def baseline_aligned_parity(spark, sf_dir):
    return _batch_aligned(spark, sf_dir, "parity")


@query(
    "C10",
    with_views(
        [*APP, "cohort"],
        f"""select SK_ID_CURR, a.TARGET, {r6('probability*100000', 'AMT_CREDIT')}, {r6('AMT_INCOME_TOTAL')},
 cast(floor(probability*10) as bigint) as CNT_CHILDREN, {r6('EXT_SOURCE_2')}
 from application_train a join cohort c on a.SK_ID_CURR=c.applicant_id""",
    ),
)
def what_if_rows(spark, sf_dir):
    """Every applicant with a scenario: new credit and children, one unknown and one empty update."""
    p = F.col("probability")
    updates = F.map_from_arrays(
        F.array(*map(F.lit, ["AMT_CREDIT", "CNT_CHILDREN", "NO_SUCH_FEATURE", "EXT_SOURCE_2"])),
        F.array(p * 100000, p * 10, F.lit(1.0), F.lit(None).cast("double")),
    )
    scenarios = view(spark, sf_dir, "cohort").select(F.col("applicant_id").alias("SK_ID_CURR"), updates.alias("updates"))
    base = view(spark, sf_dir, "application_train").select(
        "SK_ID_CURR", "TARGET", "AMT_CREDIT", "AMT_INCOME_TOTAL", "CNT_CHILDREN", "EXT_SOURCE_2"
    )
    return rounded(encode.apply_overrides(base, scenarios))


WHAT_IF = {"EXT_SOURCE_2": 0.9, "AMT_CREDIT": 100000.0}


def _score_sql(prefix):
    raw = [c for c in FEATURES if c not in ("CREDIT_INCOME_RATIO", "CREDIT_TERM")]
    terms = [f"({COEFFICIENT_SQL[c]})*coalesce({prefix}{c}, (select avg({c}) from flagged))" for c in raw]
    return f"1/(1+exp(-({INTERCEPT}e0+{'+'.join(terms)})))"


@query(
    "C10, M05",
    with_views(
        APP,
        f"""select SK_ID_CURR, {r6(_score_sql('flagged.'), 'probability')}, {r6(_score_sql('u.'), 'new_probability')}
 from flagged join (select * replace (9e-1 as EXT_SOURCE_2, 1e5 as AMT_CREDIT) from flagged) u using (SK_ID_CURR)""",
        [FLAGGED_CTE],
    ),
)
def what_if_scores(spark, sf_dir):
    """Score before and after one scenario applied to everybody."""
    df = flag_unknown_employment(view(spark, sf_dir, "application_train"))
    raw = {c: b for c, b in COEFFICIENTS.items() if c in df.columns}
    model = explain.LinearModel(INTERCEPT, raw, encode.baseline_means(df, list(raw)).first().asDict())
    updates = F.create_map(*[F.lit(x) for pair in WHAT_IF.items() for x in pair])
    scenarios = df.select("SK_ID_CURR", explain.probability(model).alias("probability"), updates.alias("updates"))
    changed = encode.apply_overrides(df, scenarios, keep=["probability"])
    return rounded(changed.select("SK_ID_CURR", "probability", explain.probability(model).alias("new_probability")))


_IMPUTED = ["AMT_INCOME_TOTAL", "AMT_ANNUITY", "CNT_FAM_MEMBERS", "OWN_CAR_AGE", "EXT_SOURCE_1", "EXT_SOURCE_2"]


@query(
    "C03, C11",
    with_views(
        APP,
        "select SK_ID_CURR, "
        + ", ".join(
            r6(f"coalesce(cast({c} as double), (select median({c}) from application_train))", c) for c in _IMPUTED
        )
        + " from application_train",
    ),
)
def imputed_candidates(spark, sf_dir):
    """All-missing columns go, the others get their median."""
    df = view(spark, sf_dir, "application_train").select("SK_ID_CURR", *_IMPUTED)
    df = df.withColumn("NEVER_FILLED", F.lit(None).cast("double"))
    return rounded(drop_empty_and_impute(df, candidate_columns(df)))


@query(
    "M10",
    with_views(
        APP,
        "select SK_ID_CURR, "
        + ", ".join(
            r6(f"({c}-(select avg({c}) from application_train))/(select stddev_pop({c}) from application_train)", c)
            for c in ("AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_2")
        )
        + " from application_train",
    ),
)
def standard_scaled(spark, sf_dir):
    from creditloom.operators.model import fit_scaling, scale

    df = view(spark, sf_dir, "application_train")
    columns = ["AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_2"]
    return rounded(scale(df, fit_scaling(df, columns)).select("SK_ID_CURR", *columns))


@query(
    "S07",
    with_views(
        APP,
        f"""select SK_ID_CURR, {', '.join(c for c in _INTS if c != 'SK_ID_CURR')},
 {', '.join(f'cast(cast({c} as float) as double) as {c}' for c in _DBLS)} from application_train""",
    ),
)
def narrowed_rows(spark, sf_dir):
    """The rows in their narrow types, widened again: whole numbers as they were, doubles with the digits of a float."""
    app = view(spark, sf_dir, "application_train").select(*_INTS, *_DBLS)
    narrow = tables.narrow(app)
    return narrow.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in app.schema])


@query(
    "S09",
    "select 'SK_ID_CURR' as col_name, 'bigint' as data_type union all select 'TARGET', 'bigint'"
    " union all select 'AMT_CREDIT', 'double' union all select 'CODE_GENDER', 'string' union all select 'OWNS_CAR', 'string'",
)
def declared_types(spark, sf_dir):
    """Column types of a table made for a DataFrame; a flag is stored as text."""
    app = view(spark, sf_dir, "application_train")
    rows = app.select("TARGET", "AMT_CREDIT", "CODE_GENDER", F.col("OWN_CAR_AGE").isNotNull().alias("OWNS_CAR"), "SK_ID_CURR")
    name = f"declared_{uuid.uuid4().hex}"
    tables.create_typed_table(rows, name, "SK_ID_CURR", scratch_path(spark, "declared"))
    tables.append_rows(rows, name)
    columns = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]
    return spark.createDataFrame(columns, "col_name string, data_type string")
