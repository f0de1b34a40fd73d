"""DuckDB texts of the fixture views, for the SQL oracle.

Each oracle query is ``WITH <needed fixture CTEs> <body>``; the CTEs are the
same mapping that :mod:`tidemark.sources.fixtures` builds with DataFrames.
"""

from __future__ import annotations

import re

FX: dict[str, str] = {}

FX["fx_users"] = """
SELECT c.c_custkey AS user_id, r.r_name AS geo, lower(c.c_mktsegment) AS persona,
       CASE c.c_custkey % 3 WHEN 0 THEN 'pro_monthly' WHEN 1 THEN 'pro_annual' ELSE 'pro_team_monthly' END AS plan,
       'pro' AS tier, CAST(min(o.o_orderdate) AS DATE) AS signup_date
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
     JOIN region r ON n.n_regionkey = r.r_regionkey
     LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, r.r_name, c.c_mktsegment
"""

FX["fx_subscriptions"] = """
SELECT subscription_id, user_id, term_start_date,
       CASE WHEN st = 'F' THEN lapse ELSE nx END AS term_end_date,
       CAST(ti AS BIGINT) AS term_index,
       CASE st WHEN 'F' THEN 'canceled' WHEN 'P' THEN 'downgraded' ELSE 'active' END AS status,
       CASE WHEN pr IN ('1-URGENT', '2-HIGH') THEN 'annual' ELSE 'monthly' END AS billing_period,
       ((2 * CAST(round(price * 100) AS BIGINT) + 1000) // 2000) / 100.0 AS mrr_usd,
       st = 'P' AS is_downgrade, coalesce(prev = 'F', FALSE) AS is_reactivation,
       CASE WHEN st = 'F' THEN lapse END AS cancel_date,
       CASE WHEN st = 'F' THEN CASE substring(pr, 1, 1) WHEN '1' THEN 'price' WHEN '2' THEN 'missing_features' WHEN '3' THEN 'switched'
                                                        WHEN '4' THEN 'no_longer_needed' ELSE 'other' END END AS cancel_reason
FROM (SELECT *, CAST(least(term_start_date + INTERVAL 30 DAY, coalesce(nx, term_start_date + INTERVAL 30 DAY)) AS DATE) AS lapse
      FROM (SELECT o_orderkey AS subscription_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS term_start_date,
                   o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ti,
                   lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx,
                   lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
            FROM orders) a) b
"""

FX["fx_usage"] = """
SELECT user_id, CAST(ts AS DATE) AS event_date,
       round(sum(value) / 25, 3) AS coding_hours,
       ((2 * 10000 * sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) + count(*)) // (2 * count(*))) / 10000.0 AS ai_acceptance_rate,
       CAST(count(*) AS INT) AS session_frequency, CAST(count(*) AS BIGINT) AS suggestions_shown,
       CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS suggestions_accepted,
       CAST(count(*) * 10 + sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS lines_of_code_written,
       CAST(count(DISTINCT event_type) AS INT) AS files_touched,
       CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE 1 END) AS BIGINT) AS ai_requests
FROM events GROUP BY user_id, CAST(ts AS DATE)
"""

FX["fx_tickets"] = """
SELECT event_id AS ticket_id, user_id, CAST(ts AS DATE) AS created_date,
       CASE k % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'in_app_chat' WHEN 2 THEN 'phone' ELSE 'community_forum' END AS channel,
       CASE k % 3 WHEN 0 THEN 'billing' WHEN 1 THEN 'technical' ELSE 'account' END AS category,
       k % 10 AS chat_message_count, value AS resolution_hours, k % 7 = 0 AS is_escalated,
       CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(1 + k % 5 AS DOUBLE) END AS csat_score
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events WHERE event_type = 'error') a
"""

FX["fx_campaigns"] = """
SELECT p_brand AS campaign_id,
       CASE CAST(substring(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'winback' WHEN 1 THEN 'retention' WHEN 2 THEN 'adoption' ELSE 'expansion' END AS objective,
       CAST(count(*) AS BIGINT) AS offers, round(sum(p_retailprice), 2) AS budget_usd
FROM part GROUP BY p_brand
"""

FX["fx_touches"] = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS touch_id, p.p_brand AS campaign_id, o.o_custkey AS user_id,
       CAST(l.l_shipdate AS DATE) AS touch_date,
       l.l_linestatus = 'F' AS delivered,
       l.l_linestatus = 'F' AND l.l_returnflag IN ('A', 'R') AS opened,
       l.l_linestatus = 'F' AND l.l_returnflag = 'R' AS clicked,
       l.l_linestatus = 'F' AND l.l_returnflag = 'R' AND CAST(substring(p.p_brand, 7) AS INT) % 4 = 0 AS reactivated,
       l.l_tax AS cost_usd
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
"""

FX["fx_touches_u"] = """
SELECT *, CASE CAST(substring(campaign_id, 7) AS INT) % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'push' ELSE 'in_app' END AS channel,
       opened AND NOT clicked AND (user_id + CAST(substring(campaign_id, 7) AS INT)) % 13 = 0 AS unsubscribed FROM fx_touches
"""

FX["fx_span"] = """
SELECT o_custkey AS user_id, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS m0,
       CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS m1 FROM orders GROUP BY o_custkey
"""

FX["fx_spine"] = """
SELECT user_id, CAST(unnest(generate_series(m0, m1, INTERVAL 1 MONTH)) AS DATE) AS month_start
FROM fx_span
"""

FX["fx_cover0"] = """
SELECT user_id, first, last
FROM (SELECT user_id,
             CASE WHEN is_downgrade AND term_start_date = date_trunc('month', term_start_date) THEN term_start_date
                  ELSE CAST(date_trunc('month', term_start_date) + INTERVAL 1 MONTH AS DATE) END AS first,
             CAST(date_trunc('month', term_end_date) AS DATE) AS last
      FROM fx_subscriptions) z
WHERE last IS NULL OR first <= last
"""

FX["fx_cover"] = """
SELECT user_id, first AS m, 1 AS d FROM fx_cover0
UNION ALL SELECT user_id, CAST(last + INTERVAL 1 MONTH AS DATE), -1 FROM fx_cover0 WHERE last IS NOT NULL
"""

FX["fx_at_risk"] = """
SELECT user_id, month_start
FROM (SELECT user_id, m AS month_start, sp, sum(d) OVER (PARTITION BY user_id ORDER BY m) AS n
      FROM (SELECT user_id, m, sum(d) AS d, max(sp) AS sp
            FROM (SELECT user_id, m, d, 0 AS sp FROM fx_cover UNION ALL SELECT user_id, month_start, 0, 1 FROM fx_spine) a
            GROUP BY user_id, m) b) c
WHERE n > 0 AND sp = 1
"""

FX["fx_cancels"] = """
SELECT user_id, CAST(date_trunc('month', cancel_date) AS DATE) AS m, max(cancel_date) AS cancel
FROM fx_subscriptions WHERE cancel_date IS NOT NULL GROUP BY 1, 2
"""

FX["fx_labels"] = """
SELECT s.user_id, s.month_start, u.geo,
       ar.user_id IS NOT NULL AND cn.cancel IS NOT NULL AS churned,
       CAST(coalesce(a.n, 0) AS BIGINT) AS active_days,
       coalesce(((2 * a.hc + a.n * 5000) // (2 * a.n * 5000)) / 1000.0, CAST(0 AS DOUBLE)) AS avg_coding_hours,
       coalesce(((2 * 10000 * a.k + a.n) // (2 * a.n)) / 10000.0, CAST(0 AS DOUBLE)) AS avg_acceptance_rate,
       CAST(coalesce(a.n, 0) AS DOUBLE) AS avg_session_frequency,
       CAST(coalesce(a.f, 0) AS BIGINT) AS support_tickets_30d,
       CAST(coalesce(t.n, 0) AS BIGINT) AS crm_touches_30d
FROM fx_spine s
JOIN fx_users u ON u.user_id = s.user_id
LEFT JOIN fx_at_risk ar ON ar.user_id = s.user_id AND ar.month_start = s.month_start
LEFT JOIN fx_cancels cn ON cn.user_id = s.user_id AND cn.m = s.month_start
LEFT JOIN (SELECT o_custkey AS user_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n,
                  sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS hc, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS k,
                  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f
           FROM orders GROUP BY o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE)) a
       ON a.user_id = s.user_id AND a.m = s.month_start
LEFT JOIN (SELECT user_id, CAST(date_trunc('month', touch_date) AS DATE) AS m, count(*) AS n
           FROM fx_touches GROUP BY user_id, CAST(date_trunc('month', touch_date) AS DATE)) t
       ON t.user_id = s.user_id AND t.m = s.month_start
"""

FX["fx_labels_e"] = """
SELECT l.*,
       CASE WHEN lag(l.avg_coding_hours) OVER w > 0
            THEN least(((2 * 10000 * CAST(round(l.avg_coding_hours * 1000) AS BIGINT) + CAST(round(lag(l.avg_coding_hours) OVER w * 1000) AS BIGINT))
                        // (2 * CAST(round(lag(l.avg_coding_hours) OVER w * 1000) AS BIGINT))) / 10000.0, 5.0)
            ELSE 1.0 END AS coding_hours_trend_30d,
       CAST(greatest(datediff('month', date_trunc('month', u.signup_date), l.month_start), 0) AS BIGINT) AS tenure_months
FROM fx_labels l LEFT JOIN fx_users u ON u.user_id = l.user_id
WINDOW w AS (PARTITION BY l.user_id ORDER BY l.month_start)
"""

FX["fx_predictions"] = """
SELECT user_id, month_start AS as_of_month, churn_score,
       CASE WHEN churn_score >= 0.6 THEN 'high' WHEN churn_score >= 0.3 THEN 'medium' ELSE 'low' END AS churn_risk_band
FROM (SELECT user_id, month_start,
             round(1 / (1 + exp(0.6 * avg_coding_hours - 0.5 * support_tickets_30d - 0.8)), 4) AS churn_score,
             row_number() OVER (PARTITION BY user_id ORDER BY month_start DESC) AS rn
      FROM fx_labels) z
WHERE rn = 1
"""

FX["fx_power_weeks"] = """
SELECT user_id, CAST(date_trunc('month', wk) AS DATE) AS month_start, CAST(count(*) AS BIGINT) AS power_weeks
FROM (SELECT user_id, CAST(date_trunc('week', event_date) AS DATE) AS wk
      FROM fx_usage WHERE coding_hours >= 4.0
      GROUP BY user_id, CAST(date_trunc('week', event_date) AS DATE) HAVING count(*) >= 5) w
GROUP BY user_id, CAST(date_trunc('month', wk) AS DATE)
"""

FX["fx_power"] = """
SELECT coalesce(o.user_id, q.user_id) AS user_id,
       CAST(coalesce(o.observed_months, 0) AS BIGINT) AS observed_months,
       CAST(coalesce(q.qualifying_months, 0) AS BIGINT) AS qualifying_months,
       coalesce(o.observed_months, 0) >= 1
         AND coalesce(q.qualifying_months, 0) >= ceil(0.5 * greatest(coalesce(o.observed_months, 0), 1))
         AND coalesce(q.qualifying_months, 0) > 0 AS power_user_flag,
       coalesce(q.qualifying_months, 0) > 0 AS ever_power_user
FROM (SELECT user_id, count(DISTINCT date_trunc('month', event_date)) AS observed_months FROM fx_usage GROUP BY user_id) o
FULL JOIN (SELECT user_id, count(*) AS qualifying_months FROM fx_power_weeks GROUP BY user_id) q ON o.user_id = q.user_id
"""

FX["fx_users_p"] = """
SELECT u.*, coalesce(p.power_user_flag, FALSE) AS power_user_flag
FROM fx_users u LEFT JOIN fx_power p ON p.user_id = u.user_id
"""

FX["fx_serving"] = """
SELECT u.user_id, u.geo, u.plan, u.tier, u.persona, u.power_user_flag, u.signup_date,
       ls.status AS subscription_status,
       (ls.status IN ('active', 'downgraded')) AS is_currently_subscribed,
       ls.billing_period, ls.mrr_usd,
       ll.month_start AS as_of_month, ll.churned AS churned_latest_month, ll.tenure_months,
       ll.active_days, ll.avg_coding_hours, ll.avg_acceptance_rate, ll.avg_session_frequency,
       ll.coding_hours_trend_30d, ll.support_tickets_30d, ll.crm_touches_30d
FROM fx_users_p u
LEFT JOIN (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month_start DESC) rn FROM fx_labels_e) a WHERE rn = 1) ll
       ON u.user_id = ll.user_id
LEFT JOIN (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY term_index DESC) rn FROM fx_subscriptions) b WHERE rn = 1) ls
       ON u.user_id = ls.user_id
"""

FX["fx_feat_first"] = """
SELECT user_id, campaign_id AS feature_key, CAST(date_trunc('month', min(touch_date)) AS DATE) AS first_month
FROM fx_touches GROUP BY user_id, campaign_id
"""

FX["fx_fa"] = """
SELECT s.user_id, s.month_start, CAST(coalesce(sum(n) OVER (PARTITION BY s.user_id ORDER BY s.month_start), 0) AS BIGINT) AS features_adopted
FROM fx_spine s
LEFT JOIN (SELECT f.user_id, greatest(f.first_month, x.m0) AS m, count(*) AS n
           FROM fx_feat_first f JOIN fx_span x ON x.user_id = f.user_id GROUP BY 1, 2) g
       ON g.user_id = s.user_id AND g.m = s.month_start
"""

FX["fx_state0"] = """
SELECT l.user_id, l.month_start, l.avg_coding_hours, u.plan, u.power_user_flag,
       (ar.user_id IS NOT NULL) AS at_risk,
       l.churned,
       CASE WHEN ar.user_id IS NOT NULL THEN c.cancel END AS churn_date,
       coalesce(fa.features_adopted, 0) AS features_adopted,
       r.n AS reactivation_starts
FROM fx_labels_e l
LEFT JOIN fx_at_risk ar ON ar.user_id = l.user_id AND ar.month_start = l.month_start
LEFT JOIN fx_cancels c ON c.user_id = l.user_id AND c.m = l.month_start
LEFT JOIN (SELECT user_id, CAST(date_trunc('month', term_start_date) AS DATE) AS m, count(*) AS n
           FROM fx_subscriptions WHERE is_reactivation GROUP BY 1, 2) r
       ON r.user_id = l.user_id AND r.m = l.month_start
LEFT JOIN fx_fa fa ON fa.user_id = l.user_id AND fa.month_start = l.month_start
LEFT JOIN fx_users_p u ON u.user_id = l.user_id
"""

FX["fx_state1"] = """
SELECT user_id, month_start, avg_coding_hours, plan, power_user_flag, at_risk, churned, churn_date, features_adopted,
       round(CASE WHEN avg_coding_hours <= 0 THEN 2.0
                  ELSE least(greatest(-ln(avg_coding_hours / greatest(coalesce(lag(avg_coding_hours, 1) OVER w, first_value(avg_coding_hours) OVER w), CAST(1e-6 AS DOUBLE))), -1.0), 2.0) END, 4) + 0.0 AS decline_1m,
       round(CASE WHEN avg_coding_hours <= 0 THEN 2.5
                  ELSE least(greatest(-ln(avg_coding_hours / greatest(coalesce(lag(avg_coding_hours, 3) OVER w, first_value(avg_coding_hours) OVER w), CAST(1e-6 AS DOUBLE))), -1.0), 2.5) END, 4) + 0.0 AS decline_3m,
       CASE WHEN coalesce(lag(avg_coding_hours, 1) OVER w, first_value(avg_coding_hours) OVER w) > 0
            THEN ((2 * 10000 * CAST(round(avg_coding_hours * 1000) AS BIGINT)
                   + CAST(round(coalesce(lag(avg_coding_hours, 1) OVER w, first_value(avg_coding_hours) OVER w) * 1000) AS BIGINT))
                  // (2 * CAST(round(coalesce(lag(avg_coding_hours, 1) OVER w, first_value(avg_coding_hours) OVER w) * 1000) AS BIGINT))) / 10000.0
            ELSE round(avg_coding_hours / CAST(1e-6 AS DOUBLE), 4) END AS decline_ratio,
       max(CASE WHEN churned THEN month_start END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_churn_month,
       CAST(coalesce(sum(coalesce(reactivation_starts, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS reactivations
FROM fx_state0
WINDOW w AS (PARTITION BY user_id ORDER BY month_start)
"""

FX["fx_state"] = """
SELECT *,
       CASE WHEN at_risk AND decline_ratio < 0.92 THEN 'at_risk' WHEN at_risk THEN 'active'
            WHEN lapsed THEN 'lapsed' ELSE 'not_subscribed' END AS user_state,
       CAST(datediff('month', last_churn_month, month_start) AS BIGINT) AS months_since_churn,
       coalesce(lapsed AND datediff('month', last_churn_month, month_start) <= 3 AND reactivations < 1, FALSE) AS winback_eligible
FROM (SELECT *, NOT at_risk AND last_churn_month IS NOT NULL AS lapsed FROM fx_state1) z
"""

FX["fx_cl"] = """
SELECT l.month_start, l.user_id, l.geo, st.churned, st.churn_date, l.tenure_months,
       pw.user_id IS NOT NULL AS is_power_user_month, l.active_days,
       l.avg_coding_hours, l.avg_acceptance_rate, l.avg_session_frequency, l.coding_hours_trend_30d,
       l.support_tickets_30d, st.features_adopted, l.crm_touches_30d
FROM fx_labels_e l JOIN fx_state st ON st.user_id = l.user_id AND st.month_start = l.month_start
LEFT JOIN fx_power_weeks pw ON pw.user_id = l.user_id AND pw.month_start = l.month_start
WHERE st.at_risk
"""

FX["fx_fd"] = """
SELECT user_id, feature_key, CAST(date_trunc('month', date) AS DATE) AS m,
                          CAST(count(DISTINCT date) AS BIGINT) AS fdays, CAST(sum(activations) AS BIGINT) AS acts
                   FROM (SELECT user_id, campaign_id AS feature_key, touch_date AS date, count(*) AS activations
                         FROM fx_touches GROUP BY 1, 2, 3) x GROUP BY 1, 2, 3
"""

FX["fx_ud"] = """
SELECT user_id, CAST(date_trunc('month', d) AS DATE) AS m, count(*) AS udays
                   FROM (SELECT DISTINCT user_id, touch_date AS d FROM fx_touches) y GROUP BY 1, 2
"""

FX["fx_feature_adoption"] = """
SELECT a.month_start, a.user_id, k.feature_key,
              coalesce(f.first_month <= a.month_start, FALSE) AS is_adopted,
              CASE WHEN f.first_month <= a.month_start THEN f.first_month END AS first_activation_date,
              CAST(CASE WHEN f.first_month <= a.month_start THEN coalesce(fd.acts, 0) ELSE 0 END AS BIGINT) AS activation_count,
              CAST(CASE WHEN f.first_month <= a.month_start THEN coalesce(fd.fdays, 0) ELSE 0 END AS BIGINT) AS active_days,
              round(CASE WHEN coalesce(ud.udays, 0) > 0 AND f.first_month <= a.month_start
                         THEN least(greatest(CAST(coalesce(fd.fdays, 0) AS DOUBLE) / ud.udays, 0.0), 1.0) ELSE 0.0 END, 4) AS depth_score
       FROM fx_at_risk a CROSS JOIN (SELECT DISTINCT feature_key FROM fx_fd) k
       LEFT JOIN fx_feat_first f ON f.user_id = a.user_id AND f.feature_key = k.feature_key
       LEFT JOIN fx_fd fd ON fd.user_id = a.user_id AND fd.feature_key = k.feature_key AND fd.m = a.month_start
       LEFT JOIN fx_ud ud ON ud.user_id = a.user_id AND ud.m = a.month_start
"""

FX["fx_current"] = """
SELECT s.*, p.churn_risk_band, p.churn_score FROM fx_serving s JOIN fx_predictions p USING (user_id)
"""

_ORDER = list(FX)
_REF = re.compile(r"\bfx_[a-z0-9_]+\b")


def _deps(name: str, seen: set[str]) -> None:
    for d in _REF.findall(FX[name]):
        if d in FX and d not in seen and d != name:
            seen.add(d)
            _deps(d, seen)


def with_fx(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs it (transitively) references.

    ``extra`` adds query-local CTEs (they may reference fixture views)."""
    extra = extra or {}
    seen: set[str] = set()
    text = body + " ".join(extra.values())
    for d in _REF.findall(text):
        if d in FX:
            seen.add(d)
            _deps(d, seen)
    ctes = [f"{n} AS MATERIALIZED ({FX[n].strip()})" for n in _ORDER if n in seen]
    ctes += [f"{n} AS ({t.strip()})" for n, t in extra.items()]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        # merge the body's own CTE list after the fixture CTEs
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def xm(col: str, s: int, out: int = 4) -> str:
    """SQL text of the exact half-up mean of a ``s``-decimal column to ``out``
    decimals (mirror of :func:`tidemark.functions.columns.exact_mean`)."""
    up, down = 10 ** max(out - s, 0), 10 ** max(s - out, 0)
    return (
        f"((2 * {up} * sum(CAST(round({col} * {10 ** s}) AS BIGINT)) + count({col}) * {down}) "
        f"// (2 * count({col}) * {down})) / {float(10 ** out)}"
    )
