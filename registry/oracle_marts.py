"""SQL counterparts of the quality, grain, mart, view and forecast queries."""

import math

from registry.portable import portable_sql
from registry.views import VIEWS

_ORDER_COLUMNS = (
    "order_id:l customer_id:l order_status:s order_purchase_timestamp:t order_delivered_customer_date:t "
    "order_estimated_delivery_date:t customer_unique_id:l customer_zip_code_prefix:l customer_city:s "
    "customer_state:s customer_lat:d customer_lng:d zip_city:s zip_state:s item_count:l unique_product_count:l "
    "unique_seller_count:l merchandise_revenue:m total_freight_value:m total_payment_value:m "
    "payment_record_count:l payment_type_count:l maximum_installments:l dominant_payment_type:s "
    "average_review_score:d review_count:l review_id:l review_score:l review_creation_date:t "
    "review_answer_timestamp:t product_category:s seller_state:s seller_lat:d seller_lng:d "
    "average_product_weight_g:d gross_order_value:m purchase_year:l purchase_month:l purchase_weekday:l "
    "purchase_hour:l purchase_period:t delivery_days:d delivery_delay_days:d estimated_delivery_days:d "
    "late_delivery:l realized_merchandise_revenue:m realized_freight_value:m distance_km:d"
)
_ORDERS = """SELECT *, bought AS order_purchase_timestamp, arrived AS order_delivered_customer_date,
                    promised AS order_estimated_delivery_date FROM v_orders"""

_KEYS = {
    "customers": "customer_id",
    "orders": "order_id",
    "products": "product_id",
    "sellers": "seller_id",
    "order_items": "order_id, order_item_id",
    "payments": "order_id, payment_sequential",
    "reviews": "review_id, order_id",
}
_OBSERVED = [
    ("reviews", "review_id"),
    ("reviews", "order_id"),
    ("geolocation", "geolocation_zip_code_prefix"),
    ("category_translation", "product_category_name"),
]
# table name -> columns under their contract names
_TABLES = {
    "customers": "SELECT * FROM c_customers",
    "orders": """SELECT order_id, customer_id, order_status, bought AS order_purchase_timestamp,
                 arrived AS order_delivered_customer_date, promised AS order_estimated_delivery_date FROM c_orders""",
    "order_items": "SELECT * FROM c_items",
    "payments": "SELECT * FROM c_payments",
    "reviews": "SELECT * FROM c_reviews",
    "products": """SELECT product_id, product_category_name, product_brand, product_weight_g, product_category,
                   english_name AS product_category_name_english
                   FROM c_products JOIN (SELECT p_partkey AS product_id, english_name FROM part
                                         LEFT JOIN c_translation ON source_name = p_type) USING (product_id)""",
    "sellers": "SELECT * FROM c_sellers",
    "geolocation": """SELECT zip AS geolocation_zip_code_prefix, lat AS geolocation_lat, lng AS geolocation_lng,
                      city AS geolocation_city, state AS geolocation_state FROM c_geolocation""",
    "category_translation": """SELECT source_name AS product_category_name,
                               english_name AS product_category_name_english FROM c_translation""",
}
_COLUMN_COUNT = {
    "customers": 5,
    "orders": 6,
    "order_items": 7,
    "payments": 5,
    "reviews": 5,
    "products": 6,
    "sellers": 3,
    "geolocation": 5,
    "category_translation": 2,
}


def _union(parts) -> str:
    return " UNION ALL ".join(f"({part})" for part in parts)


def _key_sql(table: str, keys: str) -> str:
    missing = " OR ".join(f"{k} IS NULL" for k in keys.split(", "))
    return f"""SELECT '{table}' AS table_name, '{keys}' AS key_columns, COUNT(*) AS rows,
        COUNT(*) FILTER (WHERE {missing}) AS missing_rows,
        (SELECT COUNT(*) FROM (SELECT 1 FROM ({_TABLES[table]}) GROUP BY {keys} HAVING COUNT(*) > 1)) AS repeated_keys,
        COUNT(*) FILTER (WHERE n > 1) AS duplicate_rows,
        COUNT(*) FILTER (WHERE n > 1 OR {missing}) = 0 AS is_key
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY {keys}) AS n FROM ({_TABLES[table]}))"""


def _join_sql(name: str, left: str, right: str, key: str) -> str:
    return f"""SELECT '{name}' AS join_name, (SELECT COUNT(*) FROM {left}) AS rows_before, COUNT(*) AS rows_after,
        COUNT(*) <> (SELECT COUNT(*) FROM {left}) AS multiplies FROM {left} LEFT JOIN {right} USING ({key})"""


def _report_sql(table: str, columns: str) -> str:
    nulls = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in columns.split())
    return f"""SELECT '{table}' AS table_name, COUNT(*) AS rows, {_COLUMN_COUNT[table]} AS columns,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM ({_TABLES[table]}))) AS duplicate_rows,
        {nulls} AS null_cells FROM ({_TABLES[table]})"""


_REPORT_COLUMNS = {
    "customers": "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state",
    "orders": "order_id customer_id order_status order_purchase_timestamp order_delivered_customer_date "
    "order_estimated_delivery_date",
    "order_items": "order_id order_item_id product_id seller_id shipping_limit_date price freight_value",
    "payments": "order_id payment_sequential payment_type payment_installments payment_value",
    "reviews": "review_id order_id review_score review_creation_date review_answer_timestamp",
    "products": "product_id product_category_name product_brand product_weight_g product_category "
    "product_category_name_english",
    "sellers": "seller_id seller_zip_code_prefix seller_state",
    "geolocation": "geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city geolocation_state",
    "category_translation": "product_category_name product_category_name_english",
}

_NOT_NULL = {
    "customers": _REPORT_COLUMNS["customers"],
    "orders": "order_id customer_id order_status order_purchase_timestamp order_estimated_delivery_date",
    "order_items": "order_id order_item_id product_id seller_id price freight_value",
    "payments": _REPORT_COLUMNS["payments"],
    "reviews": "review_id order_id review_score",
    "products": "product_id",
    "sellers": _REPORT_COLUMNS["sellers"],
}

_RANGES = [
    ("order_items", "price_not_negative", "price < 0"),
    ("order_items", "freight_not_negative", "freight_value < 0"),
    ("payments", "installments_not_negative", "payment_installments < 0"),
    ("payments", "value_not_negative", "payment_value < 0"),
    ("reviews", "score_between_1_and_5", "review_score NOT BETWEEN 1 AND 5"),
]

_FOREIGN = [
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("order_items", "seller_id", "sellers"),
    ("payments", "order_id", "orders"),
    ("reviews", "order_id", "orders"),
]


# ---- the tables as a text export: (row number, columns as name:letter)
# letters: i bigint, n int, d double, m decimal(12,2), s text, t date
_EXPORT = {
    "customers": ("customer_id", "customer_id:i customer_unique_id:i customer_zip_code_prefix:n customer_city:s customer_state:s"),
    "orders": (
        "order_id",
        "order_id:i customer_id:i order_status:s order_purchase_timestamp:t order_delivered_customer_date:t "
        "order_estimated_delivery_date:t",
    ),
    "order_items": (
        "order_id + order_item_id",
        "order_id:i order_item_id:n product_id:i seller_id:i shipping_limit_date:t price:m freight_value:m",
    ),
    "payments": (
        "order_id + payment_sequential",
        "order_id:i payment_sequential:n payment_type:s payment_installments:n payment_value:m",
    ),
    "reviews": ("review_id", "review_id:i order_id:i review_score:n review_creation_date:t review_answer_timestamp:t"),
    "products": ("product_id", "product_id:i product_category_name:s product_brand:s product_weight_g:d"),
    "sellers": ("seller_id", "seller_id:i seller_zip_code_prefix:n seller_state:s"),
    "geolocation": (
        "geolocation_zip_code_prefix",
        "geolocation_zip_code_prefix:n geolocation_lat:d geolocation_lng:d geolocation_city:s geolocation_state:s",
    ),
    "category_translation": (
        "length(product_category_name)",
        "product_category_name:s product_category_name_english:s",
    ),
}
_KINDS = {"i": "bigint", "n": "int", "d": "double", "m": "decimal(12,2)", "s": "string", "t": "string"}


def _export_columns(letters: str) -> list[tuple[str, str, str]]:
    """(table, column, letter) of the columns with one of the letters."""
    listed = [(t, *c.split(":")) for t, (_, columns) in _EXPORT.items() for c in columns.split()]
    return [(t, c, kind) for t, c, kind in listed if kind in letters]


def _cell(table: str, column: str, letter: str) -> str:
    """The exported text of a cell, or the number itself."""
    number = _EXPORT[table][0]
    if letter == "t":
        return f"""CASE WHEN {column} IS NULL THEN NULL WHEN ({number}) % 7 = 3 THEN 'no date'
            WHEN ({number}) % 11 = 5 THEN '' ELSE strftime({column}, '%Y-%m-%d %H:%M:%S.%f') END"""
    if letter == "s":
        return f"CASE WHEN ({number}) % 5 = 2 THEN ' ' || chr(9) || {column} || chr(10) || ' ' ELSE {column} END"
    return column


def _readable(table: str) -> str:
    number = _EXPORT[table][0]
    return f"({number}) % 7 <> 3 AND ({number}) % 11 <> 5"


def _profile_sql(table: str, column: str, letter: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, '{_KINDS[letter]}' AS data_type, COUNT(*) AS rows,
        COUNT(*) - COUNT(v) AS nulls, round((COUNT(*) - COUNT(v)) * 100.0 / COUNT(*), 4) AS null_percentage,
        COUNT(DISTINCT v) AS distinct_values FROM (SELECT {_cell(table, column, letter)} AS v FROM ({_TABLES[table]}))"""


def _date_sql(table: str, column: str, _: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
        COUNT({column}) FILTER (WHERE {_readable(table)}) AS valid,
        COUNT({column}) FILTER (WHERE NOT ({_readable(table)})) AS invalid_non_null,
        MIN({column}) FILTER (WHERE {_readable(table)}) AS minimum,
        MAX({column}) FILTER (WHERE {_readable(table)}) AS maximum FROM ({_TABLES[table]})"""


def _numeric_sql(table: str, column: str, _: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, MIN({column}) AS minimum,
        MAX({column}) AS maximum, COUNT(*) FILTER (WHERE {column} = 0) AS zero_count,
        COUNT(*) FILTER (WHERE {column} < 0) AS negative_count,
        COUNT(*) FILTER (WHERE NOT isfinite(CAST({column} AS DOUBLE))) AS non_finite_count FROM ({_TABLES[table]})"""


def _top_sql(table: str, column: str, letter: str) -> str:
    padded = f"COUNT(*) FILTER (WHERE v <> {column})"
    source = f"(SELECT *, {_cell(table, column, letter)} AS v FROM ({_TABLES[table]}))"
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
        row_number() OVER (ORDER BY COUNT(*) DESC, v NULLS LAST) AS place, v AS value, COUNT(*) AS copies,
        (SELECT COUNT(DISTINCT v) FROM {source}) AS distinct_values, (SELECT {padded} FROM {source}) AS padded_rows
        FROM {source} GROUP BY v ORDER BY place LIMIT 10"""


def _clean_sql(table: str, column: str, _: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, COUNT(*) AS copies
        FROM ({_TABLES[table]}) GROUP BY {column}"""


def _parsed_sql(table: str, column: str, _: str) -> str:
    moment = f"CASE WHEN {_readable(table)} THEN {column} END"
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {moment} AS moment, COUNT(*) AS copies
        FROM ({_TABLES[table]}) GROUP BY {moment}"""


def _histogram_sql(source: str, columns: str, bins: int) -> str:
    def one(column: str) -> str:
        return f"""SELECT '{column}' AS measure, bin, low + (high - low) / {bins} * bin AS lower,
            low + (high - low) / {bins} * (bin + 1) AS upper, COUNT(*) AS rows
            FROM (SELECT low, high, LEAST(COALESCE(
                     floor((LEAST(v, high) - low) / NULLIF((high - low) / {bins}, 0)), 0), {bins - 1}) AS bin
                  FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source}),
                       (SELECT MIN(CAST({column} AS DOUBLE)) AS low,
                               quantile_cont(CAST({column} AS DOUBLE), 0.99) AS high FROM {source}))
            GROUP BY low, high, bin"""

    return _union(one(c) for c in columns.split())


_HISTOGRAM = "measure:s bin:l lower:d upper:d rows:l"

_SLICE = """SELECT * FROM v_orders
    WHERE bought >= TIMESTAMP '1996-01-01' AND bought < TIMESTAMP '2000-01-01'
      AND customer_state IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_11')
      AND product_category IN ('Economy Line', 'Promo', 'Small Line')"""

_COMPLETE = """SELECT s.*, position <= last_position AS is_complete,
    MAX(purchase_period) FILTER (WHERE position <= last_position) OVER (PARTITION BY customer_state) AS cutoff
    FROM (SELECT *, COALESCE(MAX(CASE WHEN position >= 6 AND all_orders >= GREATEST({minimum}, usual * 0.25)
                                      THEN position END) OVER (PARTITION BY customer_state),
                             LEAST(COUNT(*) OVER (PARTITION BY customer_state) - 1, 5)) AS last_position
          FROM (SELECT *, row_number() OVER w - 1 AS position,
                       quantile_cont(all_orders, 0.5) OVER (PARTITION BY customer_state ORDER BY purchase_period
                         ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS usual
                FROM {source} WINDOW w AS (PARTITION BY customer_state ORDER BY purchase_period))) s"""

_SINE, _COSINE = (
    "[" + ", ".join(f"{of(2 * math.pi * m / 12)!r}::DOUBLE" for m in range(1, 13)) + "][season]" for of in (math.sin, math.cos)
)

_SHARED = {
    **VIEWS,
    "s_orders": _SLICE,
    "s_sold": "SELECT * FROM s_orders WHERE order_status = 'delivered'",
    "m_monthly_all": "SELECT *, 'all' AS customer_state FROM m_monthly",
    "f_all": _COMPLETE.format(minimum=50, source="m_monthly_all"),
    "f_states": _COMPLETE.format(minimum=2, source="m_monthly_state"),
    "f_months": """SELECT *, CASE WHEN position >= n - LEAST(4, GREATEST(3, n // 5)) THEN 'Validation'
                                  ELSE 'Training' END AS split, CAST(merchandise_revenue AS DOUBLE) AS v
                   FROM (SELECT *, COUNT(*) OVER (PARTITION BY customer_state) AS n FROM f_states WHERE is_complete)""",
    "f_naive": """UNPIVOT (SELECT customer_state, purchase_period, v AS actual, last_value AS "Last Value Naive",
                                  mean_value AS "Moving Average (3)", COALESCE(season_value, last_value) AS "Seasonal Naive"
                           FROM (SELECT *, LAG(v) OVER w AS last_value, LAG(v, 12) OVER w AS season_value,
                                        AVG(v) OVER (PARTITION BY customer_state ORDER BY purchase_period
                                                     ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_value
                                 FROM f_months WINDOW w AS (PARTITION BY customer_state ORDER BY purchase_period))
                           WHERE split = 'Validation')
                  ON "Last Value Naive", "Moving Average (3)", "Seasonal Naive" INTO NAME model VALUE predicted""",
    "f_steps": """SELECT customer_state, MAX(purchase_period) AS cutoff, 0 AS step, list(v ORDER BY position) AS lasts,
                         list(v ORDER BY position) AS means, list(v ORDER BY position) AS seasons
                  FROM f_months WHERE n - position <= 12 GROUP BY customer_state
                  UNION ALL
                  SELECT customer_state, cutoff, step + 1, list_append(lasts, lasts[-1]),
                         list_append(means, list_sum(means[-3:]) / len(means[-3:])),
                         list_append(seasons, CASE WHEN len(seasons) >= 12 THEN seasons[-12] ELSE seasons[-1] END)
                  FROM f_steps WHERE step < 6""",
    "f_future": """SELECT customer_state, cutoff + to_months(step) AS purchase_period, step,
                          unnest(['Last Value Naive', 'Moving Average (3)', 'Seasonal Naive']) AS model,
                          unnest([lasts[-1], means[-1], seasons[-1]]) AS predicted
                   FROM f_steps WHERE step > 0""",
    # least squares by Cramer's rule on centred sums; sums per calendar month are exact and are added in month order
    "f_phases": """SELECT customer_state, 'Validation' AS phase, position AS x, position % 12 + 1 AS season, merchandise_revenue AS r
                   FROM f_months WHERE split = 'Training'
                   UNION ALL
                   SELECT customer_state, 'Future', position, month(purchase_period), merchandise_revenue FROM f_months""",
    "f_terms": f"""SELECT customer_state, phase, season, {_SINE} AS s, {_COSINE} AS c, CAST(COUNT(*) AS DOUBLE) AS n,
                          SUM(x) AS x, SUM(x * x) AS x2, SUM(CAST(r AS DECIMAL(18,2))) AS y,
                          SUM(CAST(x AS DECIMAL(8,0)) * CAST(r AS DECIMAL(18,2))) AS x_y
                   FROM f_phases GROUP BY customer_state, phase, season""",
    "f_sums": """SELECT customer_state, phase, SUM(n) AS n, CAST(SUM(x) AS DOUBLE) AS x, CAST(SUM(x2) AS DOUBLE) AS x2,
                        CAST(SUM(y) AS DOUBLE) AS y, CAST(SUM(x_y) AS DOUBLE) AS x_y,
                        SUM(s * n ORDER BY season) AS s, SUM(c * n ORDER BY season) AS c,
                        SUM(s * s * n ORDER BY season) AS s2, SUM(c * c * n ORDER BY season) AS c2,
                        SUM(s * c * n ORDER BY season) AS s_c, SUM(s * CAST(x AS DOUBLE) ORDER BY season) AS sx,
                        SUM(c * CAST(x AS DOUBLE) ORDER BY season) AS cx, SUM(s * CAST(y AS DOUBLE) ORDER BY season) AS s_y,
                        SUM(c * CAST(y AS DOUBLE) ORDER BY season) AS c_y
                 FROM f_terms GROUP BY customer_state, phase""",
    "f_centred": """SELECT customer_state, phase, x / n AS mx, s / n AS ms, c / n AS mc, y / n AS mv,
                           x2 - x * x / n AS xx, sx - x * s / n AS xs, cx - x * c / n AS xc, s2 - s * s / n AS ss,
                           s_c - s * c / n AS sc, c2 - c * c / n AS cc, x_y - x * y / n AS xv, s_y - s * y / n AS sv,
                           c_y - c * y / n AS cv FROM f_sums""",
    "f_minors": """SELECT *, ss * cc - sc * sc AS k11, xc * sc - xs * cc AS k12, xs * sc - xc * ss AS k13,
                          xx * cc - xc * xc AS k22, xs * xc - xx * sc AS k23, xx * ss - xs * xs AS k33 FROM f_centred""",
    "f_fit": """SELECT *, (k11 * xv + k12 * sv + k13 * cv) / d AS bx, (k12 * xv + k22 * sv + k23 * cv) / d AS bs,
                       (k13 * xv + k23 * sv + k33 * cv) / d AS bc
                FROM (SELECT *, xx * k11 + xs * k12 + xc * k13 AS d FROM f_minors)""",
    "f_asked": """SELECT customer_state, 'Validation' AS phase, purchase_period, position AS x,
                         position % 12 + 1 AS season,
                         row_number() OVER (PARTITION BY customer_state ORDER BY position) AS step
                  FROM f_months WHERE split = 'Validation'
                  UNION ALL
                  SELECT customer_state, 'Future', cutoff + to_months(step), n + step - 1,
                         month(cutoff + to_months(step)), step
                  FROM (SELECT DISTINCT customer_state, cutoff, n FROM f_months), (SELECT unnest(range(1, 7)) AS step)""",
    "f_trend": """SELECT customer_state, phase, purchase_period, step,
                         GREATEST(mv + bx * (x - mx) + bs * (sine - ms) + bc * (cosine - mc), 0::DOUBLE) AS predicted
                  FROM (SELECT *, {sine} AS sine, {cosine} AS cosine FROM f_asked) JOIN f_fit USING (customer_state, phase)""".format(
        sine=_SINE, cosine=_COSINE
    ),
    "f_predictions": """SELECT customer_state, purchase_period, actual, model, predicted FROM f_naive
                        UNION ALL
                        SELECT customer_state, purchase_period, v, 'Linear Trend + Seasonality', predicted
                        FROM f_trend JOIN f_months USING (customer_state, purchase_period) WHERE phase = 'Validation'""",
    "f_chosen": """SELECT customer_state, model FROM f_predictions GROUP BY customer_state, model
                   QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY AVG((actual - predicted) ** 2),
                     list_position(['Last Value Naive', 'Moving Average (3)', 'Seasonal Naive',
                                    'Linear Trend + Seasonality'], model)) = 1""",
    "f_history": """SELECT m.customer_state, m.purchase_period, m.v AS actual, p.predicted, CAST(NULL AS DOUBLE) AS future_forecast, m.split
             FROM f_months m LEFT JOIN (SELECT * FROM f_predictions JOIN f_chosen USING (customer_state, model)) p
               ON p.customer_state = m.customer_state AND p.purchase_period = m.purchase_period
             UNION ALL
             SELECT customer_state, purchase_period, CAST(merchandise_revenue AS DOUBLE), CAST(NULL AS DOUBLE),
                    CAST(NULL AS DOUBLE), 'Excluded Partial'
             FROM f_states WHERE NOT is_complete
             UNION ALL
             SELECT customer_state, purchase_period, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), predicted,
                    'Future Forecast'
             FROM (SELECT customer_state, purchase_period, model, predicted FROM f_future
                   UNION ALL
                   SELECT customer_state, purchase_period, 'Linear Trend + Seasonality', predicted
                   FROM f_trend WHERE phase = 'Future')
             JOIN f_chosen USING (customer_state, model)""",
    "r_held": """SELECT DISTINCT order_id, product_brand AS category
                 FROM v_items WHERE order_id IN (SELECT order_id FROM v_delivered)""",
    "r_orders": "SELECT category, COUNT(*) AS orders FROM r_held GROUP BY category",
    "r_ranked": """SELECT source_category, recommended_category, co_purchase_orders, orders AS source_orders,
                          co_purchase_orders / orders::DOUBLE AS recommendation_strength
                   FROM (SELECT a.category AS source_category, b.category AS recommended_category,
                                COUNT(*) AS co_purchase_orders
                         FROM r_held a JOIN r_held b ON a.order_id = b.order_id AND a.category <> b.category
                         GROUP BY ALL)
                   JOIN r_orders ON category = source_category
                   QUALIFY row_number() OVER (PARTITION BY source_category ORDER BY co_purchase_orders DESC,
                     recommended_category > source_category DESC, recommended_category) <= 5""",
    "m_percent": """SELECT total_spend, copies, (smaller + (copies + 1) / 2) / (SELECT COUNT(*) FROM m_features) AS percent
                    FROM (SELECT total_spend, COUNT(*) AS copies,
                                 COALESCE(SUM(COUNT(*)) OVER (ORDER BY total_spend
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller
                          FROM m_features GROUP BY total_spend)""",
}

_MARTS = {
    # ---- quality
    "key_findings": (
        "table_name:s key_columns:s rows:l missing_rows:l repeated_keys:l duplicate_rows:l is_key:b",
        _union(_key_sql(t, k) for t, k in _KEYS.items()),
    ),
    "candidate_keys": (
        "table_name:s key_columns:s rows:l missing_rows:l repeated_keys:l duplicate_rows:l is_key:b",
        _union(_key_sql(t, k) for t, k in [*_KEYS.items(), *_OBSERVED]),
    ),
    "join_multiplication": (
        "join_name:s rows_before:l rows_after:l multiplies:b",
        _union(
            [
                _join_sql("orders to customers", "c_orders", "c_customers", "customer_id"),
                _join_sql("items to products", "c_items", "c_products", "product_id"),
                _join_sql("items to sellers", "c_items", "c_sellers", "seller_id"),
                _join_sql(
                    "item folds to products",
                    "(SELECT DISTINCT order_id, product_id, seller_id FROM c_items)",
                    "c_products",
                    "product_id",
                ),
                _join_sql("orders to items", "c_orders", "c_items", "order_id"),
                _join_sql("orders to payments", "c_orders", "c_payments", "order_id"),
                _join_sql("orders to reviews", "c_orders", "c_reviews", "order_id"),
                _join_sql("orders to items per order", "c_orders", "g_items", "order_id"),
                _join_sql("orders to payments per order", "c_orders", "g_payments", "order_id"),
                _join_sql("orders to reviews per order", "c_orders", "g_reviews", "order_id"),
                _join_sql("customers to zip summary", "(SELECT customer_zip_code_prefix AS zip FROM c_customers)", "v_zip", "zip"),
                _join_sql("sellers to zip summary", "(SELECT seller_zip_code_prefix AS zip FROM c_sellers)", "v_zip", "zip"),
                _join_sql(
                    "products to category names",
                    "(SELECT product_category_name AS source_name FROM c_products)",
                    "c_translation",
                    "source_name",
                ),
            ]
        ),
    ),
    "checked_order_customers": (
        "customer_id:l order_id:l customer_unique_id:l customer_state:s",
        "SELECT * FROM c_orders LEFT JOIN c_customers USING (customer_id)",
    ),
    "validation_report": (
        "table_name:s rows:l columns:l duplicate_rows:l null_cells:l",
        _union(_report_sql(t, c) for t, c in _REPORT_COLUMNS.items()),
    ),
    "identity_report": (
        "purchase_date_min:t purchase_date_max:t unique_customer_ids:l repeat_identity_count:l",
        """SELECT MIN(bought) AS purchase_date_min, MAX(bought) AS purchase_date_max,
                  (SELECT COUNT(DISTINCT customer_unique_id) FROM c_customers) AS unique_customer_ids,
                  (SELECT COUNT(*) FROM (SELECT 1 FROM c_customers GROUP BY customer_unique_id HAVING COUNT(*) > 1))
                    AS repeat_identity_count
           FROM c_orders""",
    ),
    "grain_audit": (
        "check_name:s expected:m actual:m ok:b",
        """SELECT check_name, expected, actual, expected = actual AS ok FROM (
             SELECT 'orders_kept' AS check_name, (SELECT COUNT(*) FROM orders) AS expected,
                    (SELECT COUNT(*) FROM v_orders) AS actual
             UNION ALL SELECT 'order_level_repeats', 0,
                    (SELECT COUNT(*) - COUNT(DISTINCT order_id) FROM v_orders)
             UNION ALL SELECT 'customers_kept', (SELECT COUNT(DISTINCT floor(o_custkey / 2)) FROM orders),
                    (SELECT COUNT(*) FROM m_features)
             UNION ALL SELECT 'zip_repeats', 0, (SELECT COUNT(*) - COUNT(DISTINCT zip) FROM v_zip)
             UNION ALL SELECT 'item_order_repeats', 0, (SELECT COUNT(*) - COUNT(DISTINCT order_id) FROM g_items)
             UNION ALL SELECT 'payment_order_repeats', 0, (SELECT COUNT(*) - COUNT(DISTINCT order_id) FROM g_payments)
             UNION ALL SELECT 'item_revenue', (SELECT SUM(price) FROM c_items),
                    (SELECT SUM(merchandise_revenue) FROM g_items)
             UNION ALL SELECT 'payment_value', (SELECT SUM(payment_value) FROM c_payments),
                    (SELECT SUM(total_payment_value) FROM g_payments))""",
    ),
    "range_findings": (
        "table_name:s rule:s rows:l violations:l",
        _union(
            f"""SELECT '{t}' AS table_name, '{r}' AS rule, COUNT(*) AS rows,
                COUNT(*) FILTER (WHERE {bad}) AS violations FROM ({_TABLES[t]})"""
            for t, r, bad in _RANGES
        ),
    ),
    "foreign_key_findings": (
        "child:s parent:s orphan_keys:l orphan_rows:l",
        _union(
            f"""SELECT '{child}.{key}' AS child, '{parent}.{key}' AS parent, COUNT(DISTINCT {key}) AS orphan_keys,
                COUNT(*) AS orphan_rows FROM ({_TABLES[child]}) a
                WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_TABLES[parent]}) b WHERE b.{key} = a.{key})"""
            for child, key, parent in _FOREIGN
        ),
    ),
    "null_findings": (
        "table_name:s column_name:s nulls:l",
        _union(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS nulls FROM ({_TABLES[t]})"
            for t, columns in _NOT_NULL.items()
            for c in columns.split()
        ),
    ),
    "column_profile": (
        "table_name:s column_name:s data_type:s rows:l nulls:l null_percentage:d distinct_values:l",
        _union(_profile_sql(*c) for c in _export_columns("indmst")),
    ),
    "date_profile": (
        "table_name:s column_name:s valid:l invalid_non_null:l minimum:t maximum:t",
        _union(_date_sql(*c) for c in _export_columns("t")),
    ),
    "numeric_profile": (
        "table_name:s column_name:s minimum:d maximum:d zero_count:l negative_count:l non_finite_count:l",
        _union(_numeric_sql(*c) for c in _export_columns("indm")),
    ),
    "top_values": (
        "table_name:s column_name:s place:l value:s copies:l distinct_values:l padded_rows:l",
        _union(_top_sql(*c) for c in _export_columns("s")),
    ),
    # ---- cleaning
    "clean_text": (
        "table_name:s column_name:s value:s copies:l",
        _union(_clean_sql(*c) for c in _export_columns("s")),
    ),
    "parsed_dates": (
        "table_name:s column_name:s moment:t copies:l",
        _union(_parsed_sql(*c) for c in _export_columns("t")),
    ),
    "clean_products": (
        "product_id:l product_category_name:s product_category:s product_weight_g:d",
        "SELECT * REPLACE (CASE WHEN product_weight_g > 0 THEN product_weight_g END AS product_weight_g) FROM c_products",
    ),
    # ---- grains
    "zip_summary": (
        "geolocation_zip_code_prefix:l geolocation_lat:d geolocation_lng:d geolocation_source_rows:l "
        "geolocation_state:s geolocation_city:s",
        """SELECT zip AS geolocation_zip_code_prefix, lat AS geolocation_lat, lng AS geolocation_lng,
                  seen AS geolocation_source_rows, state AS geolocation_state, city AS geolocation_city FROM v_zip""",
    ),
    "customers_geo": (
        "customer_id:l customer_unique_id:l customer_zip_code_prefix:l customer_city:s customer_state:s "
        "customer_lat:d customer_lng:d zip_city:s zip_state:s",
        "SELECT * FROM v_customers_geo",
    ),
    "sellers_geo": (
        "seller_id:l seller_zip_code_prefix:l seller_state:s seller_lat:d seller_lng:d seller_zip_city:s "
        "seller_zip_state:s",
        "SELECT * FROM v_sellers_geo",
    ),
    "enriched_items": (
        "order_id:l order_item_id:l product_id:l seller_id:l shipping_limit_date:t price:m freight_value:m "
        "product_category:s product_weight_g:d seller_state:s seller_lat:d seller_lng:d",
        "SELECT * FROM v_items",
    ),
    "items_per_order": (
        "order_id:l item_count:l unique_product_count:l unique_seller_count:l merchandise_revenue:m "
        "total_freight_value:m",
        "SELECT * FROM g_items",
    ),
    "payments_per_order": (
        "order_id:l total_payment_value:m payment_record_count:l payment_type_count:l maximum_installments:l "
        "dominant_payment_type:s",
        "SELECT * FROM g_payments",
    ),
    "reviews_per_order": (
        "order_id:l average_review_score:d review_count:l review_id:l review_score:l review_creation_date:t "
        "review_answer_timestamp:t",
        "SELECT * FROM g_reviews",
    ),
    "order_context": (
        "order_id:l product_category:s seller_state:s seller_lat:d seller_lng:d average_product_weight_g:d",
        "SELECT * FROM g_context",
    ),
    "order_level": (_ORDER_COLUMNS, _ORDERS),
    "delivery_slice": (
        "order_id:l order_purchase_timestamp:t customer_state:s seller_state:s delivery_days:d "
        "delivery_delay_days:d late_delivery:l total_freight_value:m average_review_score:d review_score:l "
        "distance_km:d",
        _ORDERS,
    ),
    "haversine_km": (
        "order_id:l distance_km:d",
        "SELECT order_id, distance_km FROM v_orders",
    ),
    "review_row_keys": (
        "row_key:l review_answer_timestamp:t review_id:l order_id:l",
        """SELECT row_number() OVER (ORDER BY review_answer_timestamp, review_id) AS row_key, review_answer_timestamp,
                  review_id, order_id FROM c_reviews""",
    ),
    "first_per_key": (
        "order_id:l order_item_id:l product_id:l seller_id:l shipping_limit_date:t price:m freight_value:m",
        """SELECT * FROM c_items QUALIFY row_number() OVER (PARTITION BY seller_id
           ORDER BY price, order_id, order_item_id, product_id, shipping_limit_date) = 1""",
    ),
    # ---- marts
    "customer_features": (
        "customer_unique_id:l total_orders:l delivered_orders:l total_spend:m total_items:l first_purchase_date:t "
        "last_purchase_date:t average_review_score:d average_delivery_days:d late_delivery_rate:d average_freight:d "
        "customer_state:s customer_city:s product_diversity:l category_diversity:l average_order_value:d recency:l "
        "frequency:l monetary:m customer_tenure:l repeat_customer:b",
        "SELECT * FROM m_features",
    ),
    "monthly_sales": (
        "purchase_period:t all_orders:l merchandise_revenue:m freight_value:m orders:l customers:l items_sold:l "
        "gross_order_value:m average_order_value:d revenue_growth:d",
        "SELECT * FROM m_monthly",
    ),
    "category_summary": (
        "product_category:s order_count:l units_sold:l merchandise_revenue:m average_price:d average_freight:d "
        "average_review:d category_share:d",
        "SELECT * FROM m_category",
    ),
    "seller_summary": (
        "seller_id:l seller_state:s orders:l merchandise_revenue:m units_sold:l average_review_score:d "
        "average_delivery_days:d late_delivery_rate:d category_reach:l geographic_reach:l",
        "SELECT * FROM m_seller",
    ),
    "cohort_retention": (
        "cohort_month:t cohort_index:l customers:l cohort_size:l retention_rate:d",
        "SELECT * FROM m_cohort",
    ),
    "cohort_matrix": (
        "cohort_month:t " + " ".join(f"month_{i:02d}:d" for i in range(13)),
        "SELECT cohort_month, "
        + ", ".join(f"MAX(retention_rate) FILTER (WHERE cohort_index = {i}) AS month_{i:02d}" for i in range(13))
        + " FROM m_cohort WHERE cohort_size >= 5 GROUP BY cohort_month",
    ),
    "state_sales": (
        "customer_state:s merchandise_revenue:m orders:l customers:l average_order_value:d",
        "SELECT * FROM m_state",
    ),
    "payment_summary": (
        "dominant_payment_type:s orders:l amount_paid:m average_installments:d",
        "SELECT * FROM m_payment",
    ),
    "customer_state_summary": (
        "customer_state:s customers:l repeat_customers:l customer_value:m average_order_value:d "
        "repeat_customer_rate:d",
        "SELECT * FROM m_customer_state",
    ),
    "delivery_state_summary": (
        "customer_state:s orders:l average_delivery_days:d late_delivery_rate:d average_freight:d average_review:d",
        "SELECT * FROM m_delivery_state",
    ),
    "review_distribution": (
        "review_score:l orders:l",
        "SELECT review_score, COUNT(*) AS orders FROM v_delivered WHERE review_score IS NOT NULL GROUP BY 1",
    ),
    "delay_review": (
        "delivery_status:s orders:l average_review:d average_delay_days:d",
        "SELECT * FROM m_delay_review",
    ),
    "orders_by_month": (
        "purchase_period:t orders:l",
        "SELECT date_trunc('month', bought) AS purchase_period, COUNT(*) AS orders FROM c_orders GROUP BY 1",
    ),
    "late_review_counts": (
        "late_delivery:l reviewed_orders:l average_review:d",
        """SELECT late_delivery, COUNT(average_review_score) AS reviewed_orders,
                  AVG(average_review_score) AS average_review
           FROM v_orders WHERE late_delivery IS NOT NULL GROUP BY 1""",
    ),
    "kpi_row": (
        "total_merchandise_revenue:m total_delivered_orders:l unique_customers:l average_order_value:d items_sold:l "
        "average_review_score:d average_delivery_days:d late_delivery_rate:d repeat_customer_rate:d "
        "cancellation_rate:d",
        "SELECT * FROM m_kpis",
    ),
    "customer_value": (
        "customer_unique_id:l total_spend:m historical_customer_value:m value_tier:s",
        """SELECT customer_unique_id, total_spend, total_spend AS historical_customer_value,
                  CASE WHEN percent >= 0.95 THEN 'Top 5%' WHEN percent >= 0.75 THEN 'High Value'
                       WHEN percent >= 0.40 THEN 'Developing' ELSE 'Low Value' END AS value_tier
           FROM m_features JOIN m_percent USING (total_spend)""",
    ),
    "seller_state_shares": (
        "seller_state:s sellers:l share:d cumulative_share:d",
        """SELECT seller_state, sellers, sellers / (SUM(sellers) OVER ())::DOUBLE AS share,
                  (SUM(sellers) OVER (ORDER BY sellers DESC RANGE UNBOUNDED PRECEDING))::DOUBLE
                  / (SUM(sellers) OVER ())::DOUBLE AS cumulative_share
           FROM (SELECT seller_state, COUNT(*) AS sellers FROM c_sellers GROUP BY seller_state)""",
    ),
    "spend_percent_rank": ("total_spend:m copies:l percent:d", "SELECT * FROM m_percent"),
    "exact_quantiles": (
        "seller_state:s fraction:d quantile:d",
        """SELECT seller_state, unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS fraction,
                  unnest(quantile_cont(CAST(price AS DOUBLE), [0.01, 0.25, 0.5, 0.75, 0.99])) AS quantile
           FROM v_items GROUP BY seller_state""",
    ),
    "order_categories": (
        "order_id:l product_category:s",
        "SELECT DISTINCT order_id, product_category FROM d_items",
    ),
    "recommendations": (
        "source_category:s recommended_category:s co_purchase_orders:l source_orders:l recommendation_strength:d",
        "SELECT * FROM r_ranked",
    ),
    "popularity": (
        "product_category:s orders:l",
        "SELECT category AS product_category, orders FROM r_orders ORDER BY orders DESC, category LIMIT 10",
    ),
    "recommendations_for": (
        "recommended_category:s co_purchase_orders:l recommendation_strength:d",
        "SELECT * FROM r_ranked WHERE source_category = 'Brand#3'",
    ),
    # ---- findings and views
    "insights": (
        "theme:s insight:s",
        """SELECT unnest(['Scale', 'Category concentration', 'Geography', 'Customer retention', 'Delivery risk',
                          'Satisfaction', 'Freight', 'Payments', 'Seasonality', 'Seller concentration',
                          'Order outcomes', 'Delivery duration']) AS theme,
             unnest([
               format('Delivered merchandise revenue was R$ {:,.2f} across {:,} delivered orders.', revenue, sold),
               (SELECT format('{} led categories with R$ {:,.2f}, or {:.1f}% of delivered merchandise revenue.',
                              product_category, CAST(merchandise_revenue AS DOUBLE), category_share * 100)
                FROM m_category ORDER BY merchandise_revenue DESC, product_category LIMIT 1),
               (SELECT format('{} generated the most delivered merchandise revenue: R$ {:,.2f} ({:.1f}% of total).',
                              customer_state, CAST(merchandise_revenue AS DOUBLE), merchandise_revenue / revenue * 100)
                FROM m_state ORDER BY merchandise_revenue DESC, customer_state LIMIT 1),
               (SELECT format('{:,} of {:,} unique customers placed more than one order identity, a {:.2f}% '
                              || 'repeat-customer rate.', COUNT(*) FILTER (WHERE repeat_customer), COUNT(*),
                              k.repeat_customer_rate * 100) FROM m_features),
               format('{:.2f}% of delivered orders with valid delivery dates arrived after the estimate.',
                      k.late_delivery_rate * 100),
               format('Average review score was {:.2f}/5; on-time orders averaged {:.2f} versus {:.2f} for late '
                      || 'orders. This is associative, not causal.', k.average_review_score,
                      (SELECT average_review FROM m_delay_review WHERE delivery_status <> 'Late'),
                      (SELECT average_review FROM m_delay_review WHERE delivery_status = 'Late')),
               (SELECT format('Delivered freight totaled {:.1f}% of merchandise revenue, highlighting logistics as a '
                              || 'material part of order value.', SUM(realized_freight_value) / revenue * 100)
                FROM v_orders),
               (SELECT format('{} was the dominant method for {:,} delivered orders.',
                  CASE dominant_payment_type WHEN 'not_available' THEN 'Not Available' ELSE dominant_payment_type END,
                  orders)
                FROM m_payment ORDER BY orders DESC, dominant_payment_type LIMIT 1),
               (SELECT format('The highest complete-month revenue occurred in {} at R$ {:,.2f}.',
                              strftime(purchase_period, '%B %Y'), CAST(merchandise_revenue AS DOUBLE))
                FROM f_all WHERE is_complete ORDER BY merchandise_revenue DESC, purchase_period LIMIT 1),
               (SELECT format('The top 10 sellers contributed {:.1f}% of delivered merchandise revenue.',
                              SUM(merchandise_revenue) / revenue * 100)
                FROM (SELECT merchandise_revenue FROM m_seller ORDER BY 1 DESC LIMIT 10)),
               (SELECT format('{:,} orders were canceled or unavailable ({:.2f}% of all orders).', COUNT(*),
                              k.cancellation_rate * 100)
                FROM c_orders WHERE order_status IN ('canceled', 'unavailable')),
               format('Average delivery time for delivered orders was {:.1f} days.', k.average_delivery_days)
             ]) AS insight
           FROM (SELECT *, CAST(total_merchandise_revenue AS DOUBLE) AS revenue, total_delivered_orders AS sold
                 FROM m_kpis) k""",
    ),
    "order_slice": (
        "order_id:l order_purchase_timestamp:t customer_state:s product_category:s merchandise_revenue:m",
        "SELECT *, bought AS order_purchase_timestamp FROM s_orders",
    ),
    "filtered_insights": (
        "theme:s insight:s",
        """SELECT unnest(['Scale', 'Primary category concentration', 'Geography', 'Customer retention',
                          'Delivery risk', 'Satisfaction', 'Freight', 'Payments']) AS theme,
             unnest([
               format('This selection generated R$ {:,.2f} across {:,} delivered orders.', revenue, sold),
               (SELECT format('{} was the leading primary category with R$ {:,.2f}, or {:.1f}% of merchandise '
                              || 'revenue.', product_category, r, r / revenue * 100)
                FROM (SELECT product_category, CAST(SUM(merchandise_revenue) AS DOUBLE) AS r FROM s_sold GROUP BY 1
                      ORDER BY 2 DESC, 1 LIMIT 1)),
               (SELECT format('{} generated the most merchandise revenue in this selection: R$ {:,.2f} ({:.1f}% of '
                              || 'total).', customer_state, r, r / revenue * 100)
                FROM (SELECT customer_state, CAST(SUM(merchandise_revenue) AS DOUBLE) AS r FROM s_sold GROUP BY 1
                      ORDER BY 2 DESC, 1 LIMIT 1)),
               (SELECT format('{:,} of {:,} unique customers placed more than one delivered order in this selection '
                              || '({:.2f}%).', COUNT(*) FILTER (WHERE n > 1), COUNT(*),
                              COUNT(*) FILTER (WHERE n > 1) / COUNT(*)::DOUBLE * 100)
                FROM (SELECT COUNT(*) AS n FROM s_sold GROUP BY customer_unique_id)),
               format('{:.2f}% of delivered orders with valid delivery dates arrived after the estimate.', late * 100),
               format('Average review score was {:.2f}/5; on-time orders averaged {:.2f} versus {:.2f} for late '
                      || 'orders. This is associative, not causal.', review, review_on_time, review_late),
               format('Delivered freight totaled {:.1f}% of merchandise revenue in this selection.',
                      freight / revenue * 100),
               (SELECT format('{} was the dominant method for {:,} delivered orders in this selection.',
                  CASE dominant_payment_type WHEN 'not_available' THEN 'Not Available' ELSE dominant_payment_type END, n)
                FROM (SELECT dominant_payment_type, COUNT(*) AS n FROM s_sold GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))
             ]) AS insight
           FROM (SELECT CAST(SUM(merchandise_revenue) AS DOUBLE) AS revenue, COUNT(*) AS sold,
                        AVG(late_delivery) AS late, AVG(average_review_score) AS review,
                        AVG(average_review_score) FILTER (WHERE late_delivery = 0) AS review_on_time,
                        AVG(average_review_score) FILTER (WHERE late_delivery = 1) AS review_late,
                        CAST(SUM(total_freight_value) AS DOUBLE) AS freight FROM s_sold)""",
    ),
    "filter_values": (
        "filter:s value:s",
        """SELECT DISTINCT 'customer_state' AS filter, customer_state AS value FROM v_orders
           UNION ALL SELECT DISTINCT 'product_category', product_category FROM v_orders
           UNION ALL SELECT 'first_day', CAST(CAST(MIN(bought) AS DATE) AS VARCHAR) FROM c_orders
           UNION ALL SELECT 'last_day', CAST(CAST(MAX(bought) AS DATE) AS VARCHAR) FROM c_orders""",
    ),
    "overview_measures": (
        "merchandise_revenue:m orders:l customers:l average_order_value:d items_sold:l late_delivery_rate:d",
        """SELECT SUM(merchandise_revenue) AS merchandise_revenue, COUNT(*) AS orders,
                  COUNT(DISTINCT customer_unique_id) AS customers,
                  CAST(SUM(merchandise_revenue) AS DOUBLE) / COUNT(*) AS average_order_value,
                  SUM(item_count) AS items_sold, AVG(late_delivery) AS late_delivery_rate FROM s_sold""",
    ),
    "overview_monthly": (
        "purchase_period:t merchandise_revenue:m orders:l",
        """SELECT purchase_period, SUM(merchandise_revenue) AS merchandise_revenue, COUNT(*) AS orders
           FROM s_sold GROUP BY 1""",
    ),
    "overview_categories": (
        "product_category:s merchandise_revenue:m",
        """SELECT product_category, SUM(merchandise_revenue) AS merchandise_revenue FROM v_delivered
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    ),
    "overview_states": (
        "customer_state:s merchandise_revenue:m",
        "SELECT * FROM m_state ORDER BY merchandise_revenue DESC, customer_state LIMIT 15",
    ),
    "sales_headline": (
        "complete_months:l peak_revenue:m latest_revenue:m latest_orders:l",
        """SELECT COUNT(*) AS complete_months, MAX(merchandise_revenue) AS peak_revenue,
                  arg_max(merchandise_revenue, purchase_period) AS latest_revenue,
                  arg_max(orders, purchase_period) AS latest_orders FROM f_all WHERE is_complete""",
    ),
    "growth_months": (
        "purchase_period:t revenue_growth:d",
        "SELECT * FROM f_all WHERE is_complete AND revenue_growth IS NOT NULL",
    ),
    "sales_top_states": (
        "customer_state:s merchandise_revenue:m orders:l customers:l average_order_value:d",
        "SELECT * FROM m_state ORDER BY merchandise_revenue DESC, customer_state LIMIT 12",
    ),
    "customer_headline": (
        "unique_customers:l repeat_customers:l repeat_customer_rate:d average_customer_value:d "
        "average_purchase_frequency:d",
        """SELECT COUNT(*) AS unique_customers, COUNT(*) FILTER (WHERE repeat_customer) AS repeat_customers,
                  AVG(CAST(repeat_customer AS INT)) AS repeat_customer_rate,
                  CAST(SUM(total_spend) AS DOUBLE) / COUNT(*) AS average_customer_value,
                  AVG(total_orders) AS average_purchase_frequency FROM m_features""",
    ),
    "customer_top_states": (
        "customer_state:s customers:l repeat_customers:l customer_value:m average_order_value:d "
        "repeat_customer_rate:d",
        "SELECT * FROM m_customer_state ORDER BY customers DESC, customer_state LIMIT 15",
    ),
    "purchase_frequency": (
        "orders:l customers:l",
        """SELECT total_orders AS orders, COUNT(*) AS customers FROM m_features GROUP BY 1 ORDER BY 1 LIMIT 8""",
    ),
    "spend_histogram": (_HISTOGRAM, _histogram_sql("m_features", "total_spend", 45)),
    "recency_histogram": (_HISTOGRAM, _histogram_sql("m_features", "recency", 45)),
    "rfm_histogram": (
        _HISTOGRAM,
        _histogram_sql("(SELECT * FROM m_features WHERE delivered_orders > 0)", "recency frequency monetary", 40),
    ),
    "rfm_base": (
        "customer_unique_id:l recency:l frequency:l monetary:m log_recency:d log_frequency:d log_monetary:d",
        """SELECT customer_unique_id, GREATEST(recency, 0) AS recency, frequency, monetary,
                  ln(1 + GREATEST(recency, 0)) AS log_recency, ln(1 + frequency) AS log_frequency,
                  ln(1 + CAST(monetary AS DOUBLE)) AS log_monetary
           FROM m_features WHERE delivered_orders > 0""",
    ),
    "top_categories": (
        "product_category:s order_count:l units_sold:l merchandise_revenue:m average_price:d average_freight:d "
        "average_review:d category_share:d",
        "SELECT * FROM m_category ORDER BY merchandise_revenue DESC, product_category LIMIT 10",
    ),
    "top_sellers": (
        "seller_id:l seller_state:s orders:l merchandise_revenue:m units_sold:l average_review_score:d "
        "average_delivery_days:d late_delivery_rate:d category_reach:l geographic_reach:l",
        "SELECT * FROM m_seller ORDER BY merchandise_revenue DESC, seller_id, seller_state LIMIT 10",
    ),
    "product_headline": (
        "leading_category:s category_revenue:m units_sold:l average_category_review:d categories:l",
        """SELECT (SELECT product_category FROM m_category ORDER BY merchandise_revenue DESC, 1 LIMIT 1)
                    AS leading_category,
                  MAX(merchandise_revenue) AS category_revenue, SUM(units_sold) AS units_sold,
                  AVG(average_review) AS average_category_review, COUNT(*) AS categories FROM m_category""",
    ),
    "delivery_headline": (
        "average_delivery_days:d late_delivery_rate:d average_freight:d average_review:d",
        """SELECT AVG(delivery_days) AS average_delivery_days, AVG(late_delivery) AS late_delivery_rate,
                  CAST(SUM(total_freight_value) AS DOUBLE) / COUNT(*) AS average_freight,
                  AVG(average_review_score) AS average_review FROM v_orders WHERE delivery_days IS NOT NULL""",
    ),
    "slow_states": (
        "customer_state:s average_delivery_days:d",
        "SELECT * FROM m_delivery_state ORDER BY average_delivery_days DESC NULLS LAST, customer_state LIMIT 15",
    ),
    "late_states": (
        "customer_state:s late_delivery_rate:d",
        "SELECT * FROM m_delivery_state ORDER BY late_delivery_rate DESC NULLS LAST, customer_state LIMIT 15",
    ),
    "seller_scorecard": (
        "seller_id:l seller_state:s orders:l merchandise_revenue:m units_sold:l average_review_score:d "
        "average_delivery_days:d late_delivery_rate:d category_reach:l geographic_reach:l",
        """SELECT * FROM m_seller WHERE orders >= 25
           ORDER BY late_delivery_rate NULLS LAST, average_review_score DESC NULLS LAST, seller_id, seller_state
           LIMIT 30""",
    ),
    # ---- forecasts
    "complete_months": (
        "customer_state:s purchase_period:t all_orders:l position:l is_complete:b cutoff:t",
        """SELECT customer_state, purchase_period, all_orders, position, is_complete, cutoff FROM f_all
           UNION ALL
           SELECT customer_state, purchase_period, all_orders, position, is_complete, cutoff FROM f_states""",
    ),
    "forecast_validation": (
        "customer_state:s purchase_period:t actual:d model:s predicted:d",
        "SELECT * FROM f_naive",
    ),
    "forecast_metrics": (
        "customer_state:s model:s mae:d rmse:d mape:d",
        """SELECT customer_state, model, AVG(abs(actual - predicted)) AS mae,
                  sqrt(AVG((actual - predicted) * (actual - predicted))) AS rmse,
                  AVG(abs(actual - predicted) / abs(actual)) FILTER (WHERE actual <> 0) AS mape
           FROM f_naive GROUP BY 1, 2""",
    ),
    "forecast_future": (
        "customer_state:s purchase_period:t model:s step:l predicted:d",
        "SELECT * FROM f_future",
    ),
    "trend_forecast": (
        "customer_state:s phase:s step:l predicted:d",
        "SELECT customer_state, phase, step, predicted FROM f_trend",
    ),
    "forecast_lines": (
        "customer_state:s line:s purchase_period:t value:d",
        """SELECT customer_state, 'Actual' AS line, purchase_period, actual AS value
           FROM f_history WHERE actual IS NOT NULL AND split <> 'Excluded Partial'
           UNION ALL SELECT customer_state, 'Predicted', purchase_period, predicted
           FROM f_history WHERE predicted IS NOT NULL
           UNION ALL SELECT customer_state, 'Future Forecast', purchase_period, future_forecast
           FROM f_history WHERE future_forecast IS NOT NULL
           UNION ALL SELECT customer_state, 'Excluded Partial', purchase_period, actual
           FROM f_history WHERE split = 'Excluded Partial'""",
    ),
    "forecast_history": (
        "customer_state:s purchase_period:t actual:d predicted:d future_forecast:d split:s",
        "SELECT customer_state, purchase_period, actual, predicted, future_forecast, split FROM f_history",
    ),
}

ORACLES = {name: portable_sql(_SHARED, spec, body) for name, (spec, body) in _MARTS.items()}
