"""SQL counterparts of the model queries that any engine can compute exactly."""

from registry.portable import portable_sql
from registry.views import VIEWS

_FEATURES = (
    "order_id:l order_purchase_timestamp:t customer_state:s seller_state:s product_category:s "
    "dominant_payment_type:s purchase_month:l purchase_weekday:l purchase_hour:l item_count:l "
    "unique_product_count:l unique_seller_count:l merchandise_revenue:m total_freight_value:m gross_order_value:m "
    "total_payment_value:m maximum_installments:l distance_km:d estimated_delivery_days:d "
    "average_product_weight_g:d late_delivery:l"
)

_RETENTION = """SELECT customer_unique_id, COUNT(*) AS orders_before_cutoff,
       SUM(merchandise_revenue) AS spend_before_cutoff, SUM(item_count) AS items_before_cutoff,
       CAST(SUM(merchandise_revenue) AS DOUBLE) / COUNT(*) AS average_order_value,
       floor(epoch_us(TIMESTAMP '2000-12-31' - MAX(bought)) / 86400000000.0) AS recency_at_cutoff,
       floor(epoch_us(MAX(bought) - MIN(bought)) / 86400000000.0) AS tenure_at_cutoff,
       CAST(SUM(total_freight_value) AS DOUBLE) / COUNT(*) AS average_freight,
       AVG({review}) AS average_review, AVG({late}) AS late_delivery_rate,
       CAST(customer_unique_id IN (SELECT customer_unique_id FROM v_delivered
         WHERE bought BETWEEN TIMESTAMP '2000-12-31' AND TIMESTAMP '2001-06-30') AS INT) AS target
FROM v_delivered WHERE bought < TIMESTAMP '2000-12-31' GROUP BY customer_unique_id"""

_RETENTION_SPEC = (
    "customer_unique_id:l orders_before_cutoff:l spend_before_cutoff:m items_before_cutoff:l average_order_value:d "
    "recency_at_cutoff:l tenure_at_cutoff:l average_freight:d average_review:d late_delivery_rate:d target:l"
)

_NUMERIC = (
    "purchase_month purchase_weekday purchase_hour item_count unique_product_count unique_seller_count merchandise_revenue "
    "total_freight_value gross_order_value total_payment_value maximum_installments distance_km estimated_delivery_days "
    "average_product_weight_g"
).split()
_CATEGORICAL = "customer_state seller_state product_category dominant_payment_type".split()


def _number_sql(column: str) -> str:
    value = f"CAST({column} AS DOUBLE)"
    return f"COALESCE({value}, (SELECT quantile_cont({value}, 0.5) FROM i_train)) AS {column}"


def _level_sql(column: str) -> str:
    """The level, the usual one where it is missing, and one name for levels seen fewer than twenty times."""
    usual = f"(SELECT {column} FROM i_train WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY COUNT(*) DESC, {column} LIMIT 1)"
    level = f"COALESCE(i_rows.{column}, {usual})"
    seen = f"(SELECT COUNT(*) FROM i_train t WHERE t.{column} = {level})"
    return f"CASE WHEN {seen} BETWEEN 1 AND 19 THEN 'infrequent' ELSE {level} END AS {column}"


def _candidate_sql(name: str, score: str) -> str:
    """Accuracy, precision, recall, F1 and both areas of one given score."""
    return f"""SELECT '{name}' AS model, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
        COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0) AS precision, tp / (tp + fn)::DOUBLE AS recall,
        2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, roc_auc, pr_auc
      FROM (SELECT COUNT(*) FILTER (WHERE s >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE s >= 0.5 AND y = 0) AS fp,
                   COUNT(*) FILTER (WHERE s < 0.5 AND y = 1) AS fn, COUNT(*) FILTER (WHERE s < 0.5 AND y = 0) AS tn
            FROM (SELECT y, {score} AS s FROM l_orders)),
           (SELECT SUM(neg * ((tp - pos) + pos / 2.0::DOUBLE)) / (ANY_VALUE(n_pos)::DOUBLE * ANY_VALUE(n_neg)) AS roc_auc,
                   SUM(pos / n_pos::DOUBLE * (tp / (tp + fp)::DOUBLE)) AS pr_auc
            FROM (SELECT s, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, pos, neg
                  FROM (SELECT s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg
                        FROM (SELECT y, {score} AS s FROM l_orders) GROUP BY s)
                  WINDOW w AS (ORDER BY s DESC)), l_totals)"""


_SHARED = {
    **VIEWS,
    "l_orders": """SELECT order_id, bought, late_delivery AS y,
                          (1300.0::DOUBLE - estimated_delivery_days + purchase_month) / 1300.0::DOUBLE AS p
                   FROM v_delivered WHERE late_delivery IS NOT NULL""",
    "l_split": """SELECT *, CASE WHEN row_number() OVER (ORDER BY bought, order_id) - 1
                                      < floor(0.8 * COUNT(*) OVER ()) THEN 'Training' ELSE 'Chronological test' END
                            AS evaluation_split FROM l_orders""",
    "l_totals": "SELECT SUM(y) AS n_pos, COUNT(*) - SUM(y) AS n_neg FROM l_orders",
    # counts at and above every distinct score, by inequality join
    "l_steps": """SELECT s.p, COUNT(*) FILTER (WHERE y = 1) AS tp, COUNT(*) FILTER (WHERE y = 0) AS fp,
                         COUNT(*) FILTER (WHERE y = 1 AND o.p = s.p) AS pos,
                         COUNT(*) FILTER (WHERE y = 0 AND o.p = s.p) AS neg
                  FROM (SELECT DISTINCT p FROM l_orders) s JOIN l_orders o ON o.p >= s.p GROUP BY s.p""",
    "l_counts": """SELECT COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
                          COUNT(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
                          COUNT(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn,
                          COUNT(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM l_orders""",
    "r_plain": _RETENTION.format(review="average_review_score", late="late_delivery"),
    "r_known": _RETENTION.format(
        review="CASE WHEN review_answer_timestamp < TIMESTAMP '2000-12-31' THEN average_review_score END",
        late="CASE WHEN arrived < TIMESTAMP '2000-12-31' THEN late_delivery END",
    ),
    "s_profiles": """SELECT customer_unique_id % 4 AS cluster, COUNT(*) AS customers,
                            AVG(GREATEST(recency, 0)) AS recency, AVG(frequency) AS frequency,
                            AVG(CAST(monetary AS DOUBLE)) AS monetary
                     FROM m_features WHERE delivered_orders > 0 GROUP BY 1""",
    "s_points": """SELECT customer_unique_id AS id, customer_unique_id % 4 AS cluster, ln(1 + GREATEST(recency, 0)) AS r,
                          ln(1 + GREATEST(frequency, 0)) AS f, ln(1 + GREATEST(CAST(monetary AS DOUBLE), 0)) AS m
                   FROM m_features WHERE delivered_orders > 0""",
    "s_distances": """SELECT a.id, a.cluster = b.cluster AS own, b.cluster AS other, SUM(pow(a.r - b.r, 2)
                             + pow(a.f - b.f, 2) + pow(a.m - b.m, 2)) AS total, COUNT(*) FILTER (WHERE a.id <> b.id) AS n
                      FROM s_points a, s_points b GROUP BY a.id, a.cluster, b.cluster""",
    "s_widths": """SELECT id, MAX(total / n) FILTER (WHERE own AND n > 0) AS inside,
                          MIN(total / n) FILTER (WHERE NOT own) AS nearest FROM s_distances GROUP BY id""",
    "s_scores": """SELECT *, - (recency - AVG(recency) OVER ()) / stddev_pop(recency) OVER ()
                             + (frequency - AVG(frequency) OVER ()) / stddev_pop(frequency) OVER ()
                             + (monetary - AVG(monetary) OVER ()) / stddev_pop(monetary) OVER () AS value_score
                   FROM s_profiles""",
    "i_rows": """SELECT v_delivered.*, evaluation_split FROM v_delivered JOIN l_split USING (order_id)""",
    "i_train": "SELECT * FROM i_rows WHERE evaluation_split = 'Training'",
    "s_named": """SELECT cluster, customers, ['Low Engagement', 'At Risk', 'Loyal', 'Champions'][row_number()
                         OVER (ORDER BY value_score, cluster)] AS segment FROM s_scores""",
    "s_segments": """SELECT f.customer_unique_id, f.recency, f.frequency, f.monetary, n.cluster,
                            COALESCE(n.segment, 'No Delivered Purchase') AS segment
                     FROM m_features f LEFT JOIN s_named n ON f.delivered_orders > 0 AND f.customer_unique_id % 4 = n.cluster""",
}

_MODELS = {
    "delivery_training_set": (
        _FEATURES,
        "SELECT *, bought AS order_purchase_timestamp FROM v_delivered WHERE late_delivery IS NOT NULL",
    ),
    "chronological_split": (
        "order_id:l order_purchase_timestamp:t evaluation_split:s",
        "SELECT *, bought AS order_purchase_timestamp FROM l_split",
    ),
    "prior_baseline": (
        "order_id:l late_delivery:l late_delivery_probability:d",
        """SELECT order_id, y AS late_delivery,
                  (SELECT AVG(y) FROM l_split WHERE evaluation_split = 'Training') AS late_delivery_probability
           FROM l_split WHERE evaluation_split <> 'Training'""",
    ),
    "class_weights": (
        "late_delivery:l rows:l weight:d",
        """SELECT y AS late_delivery, COUNT(*) AS rows, (SELECT COUNT(*) FROM l_orders) / (2.0 * COUNT(*)) AS weight
           FROM l_orders GROUP BY y""",
    ),
    "classification_metrics": (
        "accuracy:d precision:d recall:d f1:d roc_auc:d pr_auc:d",
        """SELECT (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision,
                  tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1,
                  (SELECT SUM(neg * ((tp - pos) + pos / 2.0::DOUBLE)) / (ANY_VALUE(n_pos)::DOUBLE * ANY_VALUE(n_neg))
                   FROM l_steps, l_totals) AS roc_auc,
                  (SELECT SUM(pos / n_pos::DOUBLE * (tp / (tp + fp)::DOUBLE)) FROM l_steps, l_totals) AS pr_auc
           FROM l_counts""",
    ),
    "confusion_matrix": (
        "actual:s predicted_on_time:l predicted_late:l",
        """SELECT 'Actual late' AS actual, fn AS predicted_on_time, tp AS predicted_late FROM l_counts
           UNION ALL SELECT 'Actual on time', tn, fp FROM l_counts""",
    ),
    "roc_curve": (
        "false_positive_rate:d true_positive_rate:d threshold:d",
        """SELECT fp / n_neg::DOUBLE AS false_positive_rate, tp / n_pos::DOUBLE AS true_positive_rate, p AS threshold
           FROM l_steps, l_totals UNION ALL SELECT 0, 0, NULL""",
    ),
    "pr_curve": (
        "precision:d recall:d threshold:d",
        """SELECT tp / (tp + fp)::DOUBLE AS precision, tp / n_pos::DOUBLE AS recall, p AS threshold
           FROM l_steps, l_totals UNION ALL SELECT 1, 0, NULL""",
    ),
    "risk_bands": (
        "risk_category:s orders:l",
        """SELECT CASE WHEN p <= 0.25 THEN 'Low' WHEN p <= 0.5 THEN 'Medium' ELSE 'High' END AS risk_category,
                  COUNT(*) AS orders FROM l_orders GROUP BY 1""",
    ),
    "risk_histogram": (
        "risk_category:s measure:s bin:l lower:d upper:d rows:l",
        """SELECT band AS risk_category, 'late_delivery_probability' AS measure, bin,
                  low + (high - low) / 40 * bin AS lower, low + (high - low) / 40 * (bin + 1) AS upper,
                  COUNT(*) AS rows
           FROM (SELECT CASE WHEN p <= 0.25 THEN 'Low' WHEN p <= 0.5 THEN 'Medium' ELSE 'High' END AS band, low, high,
                        LEAST(floor((p - low) / ((high - low) / 40)), 39) AS bin
                 FROM l_orders, (SELECT MIN(p) AS low, MAX(p) AS high FROM l_orders))
           GROUP BY ALL""",
    ),
    "imputed_features": (
        "order_id:l " + " ".join(f"{c}:d" for c in _NUMERIC) + " " + " ".join(f"{c}:s" for c in _CATEGORICAL),
        "SELECT order_id, " + ", ".join([*map(_number_sql, _NUMERIC), *map(_level_sql, _CATEGORICAL)]) + " FROM i_rows",
    ),
    "selected_model": (
        "model:s accuracy:d precision:d recall:d f1:d roc_auc:d pr_auc:d",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"({_candidate_sql(n, s)})"
            for n, s in (("Promise", "round(p, 1)"), ("Promise and month", "p"), ("Constant", "0.75::DOUBLE"))
        )
        + ") ORDER BY f1 DESC, pr_auc DESC, model LIMIT 1",
    ),
    "retention_split": (
        "customer_unique_id:l target:l split:s",
        """SELECT customer_unique_id, target, CASE WHEN row_number() OVER w - 1 < floor(0.75::DOUBLE * COUNT(*) OVER (PARTITION BY target))
                  THEN 'Training' ELSE 'Test' END AS split
           FROM r_plain WINDOW w AS (PARTITION BY target ORDER BY md5(customer_unique_id || ':42'), customer_unique_id)""",
    ),
    "named_segments": (
        "customer_unique_id:l cluster:l segment:s",
        "SELECT * FROM s_segments",
    ),
    "segment_counts": (
        "segment:s customers:l",
        "SELECT segment, COUNT(*) AS customers FROM s_segments GROUP BY segment",
    ),
    "segment_means": (
        "segment:s customers:l recency:d frequency:d monetary:d",
        """SELECT segment, COUNT(*) AS customers, AVG(recency) AS recency, AVG(frequency) AS frequency,
                  AVG(CAST(monetary AS DOUBLE)) AS monetary FROM s_segments GROUP BY segment""",
    ),
    "largest_segment": (
        "segment:s customers:l",
        "SELECT segment, customers FROM s_named ORDER BY customers DESC, segment LIMIT 1",
    ),
    "segment_interpretations": (
        "segment:s behaviour:s action:s",
        """SELECT segment, behaviour, action FROM s_named JOIN (VALUES
             ('Champions', 'Most recent, frequent, and valuable customers.', 'Protect loyalty with early access and recognition.'),
             ('Loyal', 'Repeat customers with consistent value.', 'Use replenishment and category-affinity campaigns.'),
             ('At Risk', 'Customers whose recency is weaker relative to their value.',
              'Test selective re-engagement based on prior category.'),
             ('Low Engagement', 'Mostly one-order customers with lower historical engagement.',
              'Use low-cost onboarding and post-purchase journeys.')) AS texts(segment, behaviour, action) USING (segment)""",
    ),
    "retention_dataset": (_RETENTION_SPEC, "SELECT * FROM r_plain"),
    "retention_known_at_cutoff": (_RETENTION_SPEC, "SELECT * FROM r_known"),
    "retention_gate": (
        "customers:l positive_count:l negative_count:l positive_rate:d model_trained:b",
        """SELECT COUNT(*) AS customers, SUM(target) AS positive_count, COUNT(*) - SUM(target) AS negative_count,
                  AVG(target) AS positive_rate,
                  SUM(target) >= 200 AND AVG(target) >= 0.005 AND COUNT(*) - SUM(target) >= 1000 AS model_trained
           FROM r_plain""",
    ),
    "silhouette": (
        "silhouette:d",
        """SELECT AVG(COALESCE((nearest - inside) / nullif(GREATEST(nearest, inside), 0), 0)) AS silhouette
           FROM s_widths""",
    ),
    "segment_naming": (
        "cluster:l customers:l recency:d frequency:d monetary:d value_score:d segment:s",
        """SELECT *, ['Low Engagement', 'At Risk', 'Loyal', 'Champions'][row_number() OVER (ORDER BY value_score, cluster)]
                     AS segment FROM s_scores""",
    ),
}

ORACLES = {name: portable_sql(_SHARED, spec, body) for name, (spec, body) in _MODELS.items()}
