"""Sync, sink, streaming and governance queries (S1-S14, ST1-ST5, P12).

These operators have side effects (they write tables); each query runs the
operation into a fresh folder under the shared ``spark.checkpoint.dir`` and
returns the resulting table read back, so its content can be checked against
the oracle text over the source tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.session import scratch_path, shuffles_dropped
from tidemark.sources import io as IO
from tidemark.sources.fixtures import Tables
from tidemark.plans.catalog import register

# Business-word aliases for regions.
REGION_ALIASES = [
    ("europe", "EMEA"),
    ("middle east", "MEA"),
    ("africa", "MEA"),
    ("asia", "APAC"),
    ("america", "NA"),
]


def _t(spark, sf):
    return Tables.of(spark, sf)


def _scratch(spark, name):
    return scratch_path(spark, f"ops/{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------------ S10 / ST5


@register("highwater_append", "SELECT * FROM fx_subscriptions")
def highwater_append(spark, sf):
    """Three syncs of a growing source: target absent (take all of the early
    state), then the full source (append ids above the watermark), then again
    (nothing new, no write).  Returns the target."""
    src = _t(spark, sf).subscriptions()
    target = _scratch(spark, "highwater")
    pivot = src.agg(F.max("subscription_id")).first()[0] // 2  # one scalar
    IO.append_above_watermark(src.filter(F.col("subscription_id") <= pivot), target, "subscription_id")
    IO.append_above_watermark(src, target, "subscription_id")
    n3 = IO.append_above_watermark(src, target, "subscription_id")
    assert n3 == 0
    return spark.read.parquet(target)


# ------------------------------------------------------------------------ S11


@register(
    "outreach_log_append",
    """SELECT CAST(row_number() OVER (ORDER BY logged_at, user_id, channel, note) AS BIGINT) AS id, user_id, channel, note, logged_at
       FROM (SELECT user_id, 'app' AS channel, 'campaign ' || campaign_id AS note, CAST(touch_date AS TIMESTAMP) AS logged_at
             FROM fx_touches WHERE delivered) z""",
)
def outreach_log_append(spark, sf):
    """Append outreach events with dense ids ``max(id)+1...`` in two
    batches (ids continue across batches)."""
    t = _t(spark, sf)
    ev = t.touches().filter("delivered").select(
        "user_id", F.lit("app").alias("channel"), F.concat(F.lit("campaign "), F.col("campaign_id")).alias("note"),
        F.col("touch_date").cast("timestamp_ntz").alias("logged_at"),
    )
    order = ["logged_at", "user_id", "channel", "note"]
    cut = ev.agg(F.percentile_approx("logged_at", 0.5)).first()[0]
    target = _scratch(spark, "outreach_log")
    IO.append_log(ev.filter(F.col("logged_at") <= F.lit(cut)), target, "id", order)
    IO.append_log(ev.filter(F.col("logged_at") > F.lit(cut)), target, "id", order)
    return spark.read.parquet(target)


# ------------------------------------------------------------------------ S12


@register(
    "upsert_latest",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY term_index DESC) AS rn
                                  FROM fx_subscriptions) z WHERE rn = 1""",
)
def upsert_latest(spark, sf):
    """base = each user's latest term before 1998; updates = every term
    from 1998 (several per key); keyed upsert keeps the newest by term_index."""
    from tidemark.operators.derive import latest_per_key

    subs = _t(spark, sf).subscriptions()
    early = F.col("term_start_date") < F.lit("1998-01-01").cast("date")
    base = latest_per_key(subs.filter(early), "user_id", "term_index").select(*subs.columns)
    return IO.upsert_latest(base, subs.filter(~early), ["user_id"], "term_index")


# ------------------------------------------------------------------------- S9


@register("published_snapshot", "SELECT * FROM fx_serving")
def published_snapshot(spark, sf):
    """Publish the serving table as a new version + pointer swap; return
    what a reader of the pointer sees."""
    target = _scratch(spark, "serving_snapshot")
    IO.publish_snapshot(_t(spark, sf).serving(), target, "user_id")
    return IO.read_snapshot(spark, target)


# ------------------------------------------------------------------------ S13


@register(
    "content_digest",
    "SELECT 'crm_touches' AS table_name, CAST(count(*) AS BIGINT) AS rows, TRUE AS same FROM fx_touches",
)
def content_digest(spark, sf):
    """Two independent builds of the touches table have equal digests."""
    a = IO.content_digest(Tables(spark, sf).touches(), "crm_touches")
    b = IO.content_digest(Tables(spark, sf).touches().repartition(7), "crm_touches")
    return IO.compare_digests(a, b)


# ------------------------------------------------------------------ S6 / S7


@register(
    "partitioned_manifest",
    """SELECT 'crm_touches' AS table_name, CAST(count(*) AS BIGINT) AS rows,
              'campaign_id,clicked,cost_usd,delivered,opened,reactivated,touch_date,touch_id,touch_month,user_id' AS columns,
              'touch_month' AS partition_by, CAST(count(DISTINCT date_trunc('month', touch_date)) AS BIGINT) AS partitions
       FROM fx_touches""",
)
def partitioned_manifest(spark, sf):
    """Write touches Hive-partitioned by month, then the manifest."""
    target = _scratch(spark, "touches_by_month")
    df = _t(spark, sf).touches().withColumn("touch_month", F.date_format("touch_date", "yyyy-MM"))
    IO.write_partitioned(df, target, by=["touch_month"])
    m = IO.manifest(spark, {"crm_touches": target}, {"crm_touches": ["touch_month"]})
    parts = spark.read.parquet(target).select(F.count_distinct("touch_month").cast("bigint").alias("partitions"))
    cols = ",".join(sorted(spark.read.parquet(target).columns))
    return m.select("table_name", "rows", F.lit(cols).alias("columns"), "partition_by", parts.scalar().alias("partitions"))


# -------------------------------------------------------------- S1-S4, ST1-ST3


def _land_usage(spark, sf, landing):
    """Land daily usage as Hive-partitioned parquet (event_date in the path, T24)."""
    from tidemark.streaming.ingest import WRITTEN

    u = _t(spark, sf).usage().select(
        "user_id", "coding_hours", F.col("ai_acceptance_rate").alias("ai_suggestion_acceptance_rate"),
        F.col("session_frequency").cast("bigint").alias("session_frequency"), "event_date",
    )
    u.write.mode("overwrite").options(**WRITTEN).partitionBy("event_date").parquet(landing)


def _landing_view(t):
    """Spec -> what makes the rows that land for it; touches and terms first, the others are made from them."""
    from tidemark.streaming import tables as IT

    return {
        IT.CRM_TOUCHES: t.touches_with_optout,
        IT.SUBSCRIPTIONS: t.subscriptions,
        IT.USERS: t.users_profile,
        IT.FEATURE_ADOPTION: t.feature_adoption,
        IT.SUPPORT_TICKETS: t.tickets,
        IT.CRM_CAMPAIGNS: t.campaigns,
        IT.CHURN_LABELS: t.churn_labels,
    }


def _landing_views(spark, sf):
    """Spec -> the rows that land for it."""
    return {spec: view() for spec, view in _landing_view(_t(spark, sf)).items()}


def _land_all(spark, sf, root):
    """All eight landing folders; spec -> folder.

    What is made from touches or terms reads those that landed; each write
    drops its exchanges.
    """
    from tidemark.streaming import tables as IT
    from tidemark.streaming.ingest import WRITTEN

    folders = {}
    t = Tables(spark, sf)
    with shuffles_dropped(spark):
        for spec, view in _landing_view(t).items():
            folders[spec] = f"{root}/landing/{spec.name}"
            view().write.mode("overwrite").options(**WRITTEN).parquet(folders[spec])
            if spec in (IT.CRM_TOUCHES, IT.SUBSCRIPTIONS):
                t.written({IT.CRM_TOUCHES: "touches", IT.SUBSCRIPTIONS: "subscriptions"}[spec], folders[spec])
        folders[IT.USAGE_EVENTS] = f"{root}/landing/usage_events"
        _land_usage(spark, sf, folders[IT.USAGE_EVENTS])
    return folders


#: table -> (oracle view, the key that the silver rows are summed by)
SILVER_VIEWS = {
    "users": ("fx_users_p", "user_id"), "subscriptions": ("fx_subscriptions", "subscription_id"), "feature_adoption": ("fx_feature_adoption", "user_id"),
    "support_tickets": ("fx_tickets", "ticket_id"), "crm_campaigns": ("fx_campaigns", "offers"), "crm_touches": ("fx_touches_u", "touch_id"),
    "churn_labels": ("fx_cl", "user_id"), "usage_events": ("fx_usage", "user_id"),
}


@register(
    "silver_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, CAST(count(*) AS BIGINT) AS silver_rows, CAST(sum({k}) AS BIGINT) AS key_sum, CAST(count(*) AS BIGINT) AS bronze_rows FROM {v}"
        for t, (v, k) in SILVER_VIEWS.items()
    ),
)
def silver_tables(spark, sf):
    """All eight tables through bronze and silver, twice; the second run adds nothing.

    bronze_rows counts bronze rows with their lineage columns set.
    """
    from tidemark.streaming.ingest import run_pipelines

    root = _scratch(spark, "ingest_all")
    folders = _land_all(spark, sf, root)
    paths = run_pipelines(spark, folders, root)
    run_pipelines(spark, folders, root)
    out = None
    for name, own in paths.items():
        key = SILVER_VIEWS[name][1]
        silver = spark.read.parquet(own["silver"]).agg(F.count(F.lit(1)).alias("silver_rows"), F.sum(key).cast("bigint").alias("key_sum"))
        lineage = F.col("_source_file").isNotNull() & F.col("_ingested_at").isNotNull()
        bronze = spark.read.parquet(own["bronze"]).agg(F.count_if(lineage))
        r = silver.select(F.lit(name).alias("dataset"), "silver_rows", "key_sum", bronze.scalar().alias("bronze_rows"))
        out = r if out is None else out.unionByName(r)
    return out


def _rules_sql():
    from tidemark.streaming import tables as IT

    views = {**{t: v for t, (v, _) in SILVER_VIEWS.items()}, "crm_touches": f"(SELECT *, {IT.OUTCOME} AS outcome FROM fx_touches_u) z"}
    parts = []
    for spec in IT.INGEST_SPECS:
        for action, rules in (("drop", spec.expect_drop), ("keep", spec.expect_keep)):
            parts += [
                f"""SELECT '{spec.name}' AS dataset, '{n}' AS rule, '{action}' AS action, CAST(count(*) - count_if(NOT coalesce({r}, FALSE)) AS BIGINT) AS passed,
                           CAST(count_if(NOT coalesce({r}, FALSE)) AS BIGINT) AS failed FROM {views[spec.name]}"""
                for n, r in rules.items()
            ]
    return " UNION ALL ".join(parts)


@register(
    "bronze_silver_stream",
    "SELECT user_id, event_date, coding_hours, ai_acceptance_rate, session_frequency FROM fx_usage WHERE user_id IS NOT NULL",
)
def bronze_silver_stream(spark, sf):
    """S1-S4/ST1/ST2: availableNow bronze then silver; a second run on the same
    files adds nothing (checkpointed progress)."""
    from tidemark.streaming.ingest import run_pipeline
    from tidemark.streaming.tables import USAGE_EVENTS

    root = _scratch(spark, "ingest")
    _land_usage(spark, sf, f"{root}/landing")
    run_pipeline(spark, USAGE_EVENTS, f"{root}/landing", root)
    run_pipeline(spark, USAGE_EVENTS, f"{root}/landing", root)  # restart: no new files
    return spark.read.parquet(f"{root}/silver/usage_events").drop("batch_id")


@register("stream_expectation_metrics", _rules_sql())
def stream_expectation_metrics(spark, sf):
    """ST3/Q2: rule counts of all eight tables, observed while their micro-batches
    were written, summed per rule (each batch id counted once)."""
    from tidemark.streaming.ingest import run_pipelines

    root = _scratch(spark, "ingest_metrics")
    paths = run_pipelines(spark, _land_all(spark, sf, root), root)
    m = spark.read.parquet(*[f"{own['metrics']}/batch_id=*" for own in paths.values()])
    return m.groupBy("dataset", "rule", "action").agg(F.sum("passed").cast("bigint").alias("passed"), F.sum("failed").cast("bigint").alias("failed"))


# ------------------------------------------------------------------------ ST4


@register(
    "live_last_touch",
    "SELECT user_id, max(CAST(touch_date AS TIMESTAMP)) AS last_touch FROM fx_touches GROUP BY user_id",
)
def live_last_touch(spark, sf):
    """ST4: outreach events arrive as files in two drops; each micro-batch rewrites
    only the buckets of a keyed table that its users are in."""
    from tidemark.streaming.keyed import KeyedTable, start_upserts

    root = _scratch(spark, "last_touch")
    table = KeyedTable(f"{root}/table", buckets=16)
    log = _t(spark, sf).touches().select("user_id", F.col("touch_date").cast("timestamp_ntz").alias("last_touch"))
    cut = log.agg(F.percentile_approx("last_touch", 0.5)).first()[0]
    drops = (F.col("last_touch") <= F.lit(cut), F.col("last_touch") > F.lit(cut))
    for n, drop in enumerate(drops):
        log.filter(drop).write.mode("append").parquet(f"{root}/landing/drop={n}")
        stream = spark.readStream.schema("user_id BIGINT, last_touch TIMESTAMP_NTZ").parquet(f"{root}/landing/*")
        start_upserts(stream, table, f"{root}/_ckpt").awaitTermination()
    return table.read(spark)


# ------------------------------------------------------------------------ P12


def _alias_sql():
    cases = " ".join(f"WHEN lower(geo) = '{w}' THEN '{c}'" for w, c in REGION_ALIASES)
    return f"SELECT user_id, CASE {cases} ELSE geo END AS geo FROM fx_users"


@register("alias_resolution", _alias_sql())
def alias_resolution(spark, sf):
    from tidemark.operators.worklist import alias_values

    aliases = spark.createDataFrame(REGION_ALIASES, "word string, canonical string")
    return alias_values(_t(spark, sf).users().select("user_id", "geo"), "geo", aliases)


# --------------------------------------------------------------------- ML U3-U12

_MODELS: dict = {}


def _model(spark, sf):
    from tidemark.operators import ml as M

    key = (id(spark), sf)
    if key not in _MODELS:
        root = _scratch(spark, "models")
        # the last month is cut short by the end of the data: the one before it is held out
        labels = _t(spark, sf).churn_labels()
        model, valid, holdout = M.train(labels.where(F.col("month_start") < labels.agg(F.max("month_start")).scalar()))
        version = M.save_version(spark, model, root)
        loaded, v = M.load_alias(spark, root)
        _MODELS[key] = (loaded, v, valid)
    return _MODELS[key]


@register(
    "temporal_split",
    """SELECT CASE WHEN month_start = (SELECT max(month_start) FROM fx_cl) THEN 'valid' ELSE 'train' END AS split,
              CAST(count(*) AS BIGINT) AS rows, CAST(count_if(churned) AS BIGINT) AS positives
       FROM fx_cl GROUP BY 1""",
)
def temporal_split(spark, sf):
    from tidemark.operators import ml as M

    tr, va, _ = M.temporal_split(_t(spark, sf).churn_labels())
    agg = [F.count(F.lit(1)).cast("bigint").alias("rows"), F.count_if("churned").cast("bigint").alias("positives")]
    return tr.agg(*agg).select(F.lit("train").alias("split"), "*").unionByName(va.agg(*agg).select(F.lit("valid").alias("split"), "*"))


@register(
    "class_weights",
    """SELECT churned, CAST(count(*) AS BIGINT) AS rows, weight FROM (
         SELECT churned, round(CASE WHEN p <= 0 OR p >= 1 THEN 1.0 WHEN churned THEN (1 - p) / p ELSE 1.0 END, 4) AS weight
         FROM fx_cl, (SELECT avg(CAST(churned AS DOUBLE)) AS p FROM fx_cl) a) z
       GROUP BY churned, weight""",
)
def class_weights(spark, sf):
    from tidemark.operators import ml as M

    w = M.with_class_weight(_t(spark, sf).churn_labels())
    return w.groupBy("churned", F.round("weight", 4).alias("weight")).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


@register(
    "gbt_scores",
    """SELECT user_id, max(month_start) AS as_of_month, 'churn_gbt' AS model_name, TRUE AS in_range, TRUE AS band_fits
       FROM fx_cl GROUP BY user_id""",
)
def gbt_scores(spark, sf):
    """The champion model scores each user's latest label row; what can
    be checked of a score: its range and that the band is the score's."""
    from tidemark.functions.columns import risk_band
    from tidemark.operators import ml as M

    model, version, _ = _model(spark, sf)
    scored = M.score_latest(model, _t(spark, sf).churn_labels(), version)
    edge = F.col("churn_score").isin(0.3, 0.6)  # a rounded score may sit on a band's edge
    return scored.select(
        "user_id",
        "as_of_month",
        "model_name",
        F.col("churn_score").between(0, 1).alias("in_range"),
        (edge | (F.col("churn_risk_band") == risk_band(F.col("churn_score")))).alias("band_fits"),
    )


@register(
    "model_evaluation",
    """SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(CAST(churned AS DOUBLE)), 6) AS base_rate, TRUE AS areas_in_range,
              TRUE AS beats_chance, TRUE AS beats_base_rate
       FROM fx_cl WHERE month_start = (SELECT max(month_start) FROM fx_cl WHERE month_start < (SELECT max(month_start) FROM fx_cl))""",
)
def model_evaluation(spark, sf):
    """U8: on the held-out month the model must order rows better than chance
    (ROC area) and better than the base rate (PR area).

    The last month of the data is cut off by its end, so the month before it is held out."""
    from tidemark.operators import ml as M

    labels = _t(spark, sf).churn_labels()
    labels = labels.where(F.col("month_start") < labels.agg(F.max("month_start")).scalar())
    model, valid, _ = M.train(labels)
    areas = F.col("roc_auc").between(0, 1) & F.col("pr_auc").between(0, 1)
    return M.evaluate(model, valid).select(
        "rows", F.round("base_rate", 6).alias("base_rate"), areas.alias("areas_in_range"),
        (F.col("roc_auc") > 0.5).alias("beats_chance"), (F.col("pr_auc") > F.col("base_rate")).alias("beats_base_rate"),
    )


@register(
    "score_areas",
    """WITH s AS (SELECT CAST(round(p.churn_score * 10000) AS INT) AS level, CAST(l.churned AS INT) AS y
                  FROM fx_predictions p JOIN fx_labels l ON l.user_id = p.user_id AND l.month_start = p.as_of_month),
            c AS (SELECT level, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY level),
            r AS (SELECT *, sum(p) OVER (ORDER BY level DESC) AS tp, sum(n) OVER (ORDER BY level DESC) AS fp FROM c)
       SELECT CAST(sum(p + n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives, round(sum(p) / sum(p + n), 6) AS base_rate,
              round(sum(n * (2 * tp - p)) / (2.0 * sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 6) AS pr_auc
       FROM r""",
)
def score_areas(spark, sf):
    """U8: exact areas of the given scores against churn in the scored month."""
    from tidemark.operators import ml as M

    t = _t(spark, sf)
    # by user only, as both sides are dealt; the month is a number so that it does not become a second key
    labels = t.labels().select("user_id", "month_start", "churned")
    scored = labels.join(t.predictions().hint("shuffle_hash"), "user_id").where(F.datediff("month_start", "as_of_month") == 0)
    return M.score_areas(scored, label="churned").select("rows", "positives", *[F.round(c, 6).alias(c) for c in ("base_rate", "roc_auc", "pr_auc")])


@register(
    "bands_by_capacity",
    """SELECT user_id, as_of_month, churn_score, churn_risk_band, score_rank,
              CASE WHEN score_rank <= 100 THEN 'high' WHEN score_rank <= 400 THEN 'medium' ELSE 'low' END AS capacity_band
       FROM (SELECT *, CAST(row_number() OVER (ORDER BY churn_score DESC, user_id) AS BIGINT) AS score_rank FROM fx_predictions) z""",
)
def bands_by_capacity(spark, sf):
    from tidemark.operators import ml as M

    return M.bands_by_capacity(_t(spark, sf).predictions(), n_high=100, n_medium=300)
