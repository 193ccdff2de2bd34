"""SQL views shared by the oracles: the marketplace tables, the grains, the order table, the marts."""

VIEWS: dict[str, str] = {}

VIEWS["c_customers"] = """
SELECT c_custkey AS customer_id, CAST(FLOOR(c_custkey / 2) AS BIGINT) AS customer_unique_id,
       c_nationkey AS customer_zip_code_prefix, c_mktsegment AS customer_city, n_name AS customer_state
FROM customer JOIN nation ON n_nationkey = c_nationkey"""

VIEWS["c_orders"] = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped'
            WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'unavailable' END AS order_status,
       o_orderdate AS bought,
       CASE WHEN last_ship >= o_orderdate THEN last_ship END AS arrived,
       o_orderdate + CASE o_orderpriority WHEN '1-URGENT' THEN INTERVAL '365' DAY
            WHEN '2-HIGH' THEN INTERVAL '545' DAY WHEN '3-MEDIUM' THEN INTERVAL '730' DAY
            WHEN '4-NOT SPECIFIED' THEN INTERVAL '910' DAY ELSE INTERVAL '1095' DAY END AS promised
FROM orders
LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey)
  ON l_orderkey = o_orderkey"""

VIEWS["c_items"] = """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
       l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value
FROM lineitem"""

VIEWS["c_payments"] = """
SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_returnflag AS payment_type,
       CAST(l_quantity AS INT) AS payment_installments, CAST(l_extendedprice AS DECIMAL(12,2)) AS payment_value
FROM lineitem"""

VIEWS["c_reviews"] = """
SELECT event_id AS review_id, CAST(FLOOR(event_id / 2) AS BIGINT) AS order_id,
       1 + CAST(FLOOR(value) AS INT) % 5 AS review_score, ts AS review_creation_date, ts AS review_answer_timestamp
FROM events"""

VIEWS["c_translation"] = """
SELECT * FROM (VALUES ('ECONOMY', 'economy_line'), ('SMALL', 'small_line'), ('LARGE', 'large_line'))
  AS dictionary(source_name, english_name)"""

VIEWS["c_products"] = """
SELECT p_partkey AS product_id, p_type AS product_category_name, p_brand AS product_brand,
       CAST(p_size AS DOUBLE) AS product_weight_g,
       COALESCE(english_name, p_type, 'Unknown') AS category,
       array_to_string(list_transform(
         regexp_extract_all(lower(replace(COALESCE(english_name, p_type, 'Unknown'), '_', ' ')), '[a-z]+|[^a-z]+'),
         lambda w: upper(w[1:1]) || w[2:]), '') AS product_category
FROM part LEFT JOIN c_translation ON source_name = p_type"""

VIEWS["c_sellers"] = """
SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix, n_name AS seller_state
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""

VIEWS["c_geolocation"] = """
SELECT c_nationkey AS zip, c_acctbal / 200 - 34 AS lat, CAST(-80 + c_custkey % 55 AS DOUBLE) AS lng,
       c_mktsegment AS city, CAST(c_custkey % 5 AS VARCHAR) AS state
FROM customer"""

VIEWS["v_zip"] = """
SELECT spots.zip, spots.lat, spots.lng, spots.seen, places.state, places.city
FROM (SELECT zip, COUNT(*) AS seen,
             quantile_cont(lat, 0.5) FILTER (WHERE lat BETWEEN -34 AND 6 AND lng BETWEEN -75 AND -30) AS lat,
             quantile_cont(lng, 0.5) FILTER (WHERE lat BETWEEN -34 AND 6 AND lng BETWEEN -75 AND -30) AS lng
      FROM c_geolocation GROUP BY zip) spots
JOIN (SELECT zip, state, city FROM (SELECT zip, state, city, COUNT(*) AS n FROM c_geolocation GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY zip ORDER BY n DESC, state NULLS LAST, city NULLS LAST) = 1) places
  ON places.zip = spots.zip"""

VIEWS["v_customers_geo"] = """
SELECT c_customers.*, lat AS customer_lat, lng AS customer_lng, city AS zip_city, state AS zip_state
FROM c_customers LEFT JOIN v_zip ON zip = customer_zip_code_prefix"""

VIEWS["v_sellers_geo"] = """
SELECT c_sellers.*, lat AS seller_lat, lng AS seller_lng, city AS seller_zip_city, state AS seller_zip_state
FROM c_sellers LEFT JOIN v_zip ON zip = seller_zip_code_prefix"""

VIEWS["v_items"] = """
SELECT c_items.*, COALESCE(p.product_category, 'Unknown') AS product_category, p.category, p.product_brand,
       p.product_weight_g, s.seller_state, s.seller_lat, s.seller_lng
FROM c_items LEFT JOIN c_products p ON p.product_id = c_items.product_id
LEFT JOIN v_sellers_geo s ON s.seller_id = c_items.seller_id"""

VIEWS["g_items"] = """
SELECT order_id, COUNT(*) AS item_count, COUNT(DISTINCT product_id) AS unique_product_count,
       COUNT(DISTINCT seller_id) AS unique_seller_count, SUM(price) AS merchandise_revenue,
       SUM(freight_value) AS total_freight_value
FROM c_items GROUP BY order_id"""

VIEWS["g_payments"] = """
SELECT totals.*, tops.payment_type AS dominant_payment_type
FROM (SELECT order_id, SUM(payment_value) AS total_payment_value, COUNT(*) AS payment_record_count,
             COUNT(DISTINCT payment_type) AS payment_type_count, MAX(payment_installments) AS maximum_installments
      FROM c_payments GROUP BY order_id) totals
JOIN (SELECT order_id, payment_type FROM c_payments GROUP BY order_id, payment_type
      QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY SUM(payment_value) DESC, payment_type) = 1) tops
  ON tops.order_id = totals.order_id"""

VIEWS["g_latest"] = """
SELECT * FROM c_reviews
QUALIFY row_number() OVER (PARTITION BY order_id
  ORDER BY review_answer_timestamp DESC NULLS FIRST, review_id DESC NULLS FIRST) = 1"""

VIEWS["g_reviews"] = """
SELECT order_id, average_review_score, review_count, review_id, review_score, review_creation_date,
       review_answer_timestamp
FROM g_latest JOIN (SELECT order_id, AVG(review_score) AS average_review_score, COUNT(*) AS review_count
                    FROM c_reviews GROUP BY order_id) USING (order_id)"""

VIEWS["g_context"] = """
SELECT order_id, product_category, seller_state, seller_lat, seller_lng, average_product_weight_g
FROM (SELECT order_id, product_category, seller_state, seller_lat, seller_lng FROM v_items
      QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY price + freight_value DESC, order_item_id,
                                 product_id, seller_id, shipping_limit_date) = 1)
JOIN (SELECT order_id, AVG(product_weight_g) AS average_product_weight_g FROM v_items GROUP BY order_id)
  USING (order_id)"""

VIEWS["v_orders"] = """
SELECT o.order_id, o.customer_id, order_status, bought, arrived, promised,
       customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, customer_lat, customer_lng,
       zip_city, zip_state,
       COALESCE(item_count, 0) AS item_count, COALESCE(unique_product_count, 0) AS unique_product_count,
       COALESCE(unique_seller_count, 0) AS unique_seller_count,
       COALESCE(merchandise_revenue, 0) AS merchandise_revenue,
       COALESCE(total_freight_value, 0) AS total_freight_value,
       COALESCE(total_payment_value, 0) AS total_payment_value,
       COALESCE(payment_record_count, 0) AS payment_record_count,
       COALESCE(payment_type_count, 0) AS payment_type_count, maximum_installments,
       COALESCE(dominant_payment_type, 'not_available') AS dominant_payment_type,
       average_review_score, COALESCE(review_count, 0) AS review_count, review_id, review_score,
       review_creation_date, review_answer_timestamp,
       COALESCE(product_category, 'Unknown') AS product_category, COALESCE(seller_state, 'Unknown') AS seller_state,
       seller_lat, seller_lng, average_product_weight_g,
       COALESCE(merchandise_revenue, 0) + COALESCE(total_freight_value, 0) AS gross_order_value,
       year(bought) AS purchase_year, month(bought) AS purchase_month, isodow(bought) - 1 AS purchase_weekday,
       hour(bought) AS purchase_hour, CAST(date_trunc('month', bought) AS TIMESTAMP) AS purchase_period,
       epoch_us(arrived - bought) / 86400000000.0::DOUBLE AS delivery_days,
       epoch_us(arrived - promised) / 86400000000.0::DOUBLE AS delivery_delay_days,
       epoch_us(promised - bought) / 86400000000.0::DOUBLE AS estimated_delivery_days,
       CASE WHEN order_status = 'delivered' THEN CAST(arrived > promised AS INT) END AS late_delivery,
       CASE WHEN order_status = 'delivered' THEN COALESCE(merchandise_revenue, 0) ELSE 0 END
         AS realized_merchandise_revenue,
       CASE WHEN order_status = 'delivered' THEN COALESCE(total_freight_value, 0) ELSE 0 END
         AS realized_freight_value,
       2 * 6371.0088 * asin(sqrt(
         pow(sin(radians(seller_lat - customer_lat) / 2), 2)
         + cos(radians(customer_lat)) * cos(radians(seller_lat))
         * pow(sin(radians(seller_lng - customer_lng) / 2), 2))) AS distance_km
FROM c_orders o LEFT JOIN v_customers_geo USING (customer_id) LEFT JOIN g_items USING (order_id)
LEFT JOIN g_payments USING (order_id) LEFT JOIN g_reviews USING (order_id) LEFT JOIN g_context USING (order_id)"""

VIEWS["v_delivered"] = "SELECT * FROM v_orders WHERE order_status = 'delivered'"

VIEWS["d_items"] = """
SELECT v_items.*, d.customer_unique_id, d.customer_state, d.purchase_period, d.purchase_year,
       d.average_review_score, d.delivery_days, d.late_delivery
FROM v_items JOIN v_delivered d ON d.order_id = v_items.order_id"""

VIEWS["m_features"] = """
SELECT base.*, CAST(total_spend AS DOUBLE) / NULLIF(delivered_orders, 0) AS average_order_value,
       CAST(floor(epoch_us((SELECT date_trunc('day', MAX(bought)) + INTERVAL 1 DAY FROM c_orders) - last_purchase_date)
            / 86400000000.0) AS INT) AS recency,
       delivered_orders AS frequency, total_spend AS monetary,
       CAST(floor(epoch_us(last_purchase_date - first_purchase_date) / 86400000000.0) AS INT) AS customer_tenure,
       total_orders > 1 AS repeat_customer, COALESCE(products, 0) AS product_diversity,
       COALESCE(categories, 0) AS category_diversity
FROM (SELECT customer_unique_id, COUNT(DISTINCT order_id) AS total_orders,
             COUNT(*) FILTER (WHERE order_status = 'delivered') AS delivered_orders,
             SUM(realized_merchandise_revenue) AS total_spend,
             COALESCE(SUM(item_count) FILTER (WHERE order_status = 'delivered'), 0) AS total_items,
             MIN(bought) AS first_purchase_date, MAX(bought) AS last_purchase_date,
             AVG(average_review_score) AS average_review_score, AVG(delivery_days) AS average_delivery_days,
             AVG(late_delivery) AS late_delivery_rate,
             CAST(SUM(realized_freight_value) AS DOUBLE) / COUNT(*) AS average_freight,
             arg_min(customer_state, ROW(bought, order_id)) AS customer_state,
             arg_min(customer_city, ROW(bought, order_id)) AS customer_city
      FROM v_orders GROUP BY customer_unique_id) base
LEFT JOIN (SELECT customer_unique_id, COUNT(DISTINCT product_id) AS products,
                  COUNT(DISTINCT product_category) AS categories
           FROM d_items GROUP BY customer_unique_id) variety
  ON variety.customer_unique_id = base.customer_unique_id"""

_MONTHLY = """
SELECT *, CAST(merchandise_revenue - before AS DOUBLE) / NULLIF(CAST(before AS DOUBLE), 0) AS revenue_growth
FROM (SELECT spine.*, merchandise_revenue + freight_value AS gross_order_value,
             CAST(merchandise_revenue AS DOUBLE) / NULLIF(orders, 0) AS average_order_value,
             LAG(merchandise_revenue) OVER ({partition} ORDER BY purchase_period) AS before
      FROM (SELECT {key} purchase_period, COUNT(*) AS all_orders,
                   SUM(realized_merchandise_revenue) AS merchandise_revenue,
                   SUM(realized_freight_value) AS freight_value,
                   COUNT(*) FILTER (WHERE order_status = 'delivered') AS orders,
                   COUNT(DISTINCT customer_unique_id) FILTER (WHERE order_status = 'delivered') AS customers,
                   COALESCE(SUM(item_count) FILTER (WHERE order_status = 'delivered'), 0) AS items_sold
            FROM v_orders GROUP BY ALL) spine)"""
VIEWS["m_monthly"] = _MONTHLY.format(partition="", key="")
VIEWS["m_monthly_state"] = _MONTHLY.format(
    partition="PARTITION BY customer_state", key="customer_state,"
)

VIEWS["m_category"] = """
SELECT product_category, COUNT(*) AS order_count, SUM(units) AS units_sold, SUM(revenue) AS merchandise_revenue,
       AVG(price) AS average_price, AVG(freight) AS average_freight, AVG(review) AS average_review,
       CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(SUM(revenue)) OVER () AS DOUBLE) AS category_share
FROM (SELECT product_category, order_id, COUNT(*) AS units, SUM(price) AS revenue,
             CAST(SUM(price) AS DOUBLE) / COUNT(price) AS price,
             CAST(SUM(freight_value) AS DOUBLE) / COUNT(freight_value) AS freight,
             ANY_VALUE(average_review_score) AS review
      FROM d_items GROUP BY product_category, order_id)
GROUP BY product_category"""

VIEWS["m_seller"] = """
SELECT seller_id, seller_state, COUNT(*) AS orders, SUM(revenue) AS merchandise_revenue, SUM(units) AS units_sold,
       AVG(review) AS average_review_score, AVG(days) AS average_delivery_days, AVG(late) AS late_delivery_rate,
       SUM(categories) AS category_reach, COUNT(DISTINCT customer_state) AS geographic_reach
FROM (SELECT seller_id, seller_state, order_id, COUNT(*) AS units, SUM(price) AS revenue,
             COUNT(DISTINCT product_category) AS categories, ANY_VALUE(average_review_score) AS review,
             ANY_VALUE(delivery_days) AS days, ANY_VALUE(late_delivery) AS late,
             ANY_VALUE(customer_state) AS customer_state
      FROM d_items GROUP BY seller_id, seller_state, order_id)
GROUP BY seller_id, seller_state"""

VIEWS["m_cohort"] = """
SELECT cells.*, cohort_size, CAST(customers AS DOUBLE) / cohort_size AS retention_rate
FROM (SELECT cohort_month, datediff('month', cohort_month, purchase_period) AS cohort_index,
             COUNT(DISTINCT customer_unique_id) AS customers
      FROM v_delivered JOIN (SELECT customer_unique_id, MIN(purchase_period) AS cohort_month
                             FROM v_delivered GROUP BY customer_unique_id) USING (customer_unique_id)
      GROUP BY ALL) cells
JOIN (SELECT cohort_month, COUNT(*) AS cohort_size
      FROM (SELECT MIN(purchase_period) AS cohort_month FROM v_delivered GROUP BY customer_unique_id)
      GROUP BY cohort_month) sizes USING (cohort_month)"""

VIEWS["m_state"] = """
SELECT customer_state, SUM(merchandise_revenue) AS merchandise_revenue, COUNT(*) AS orders,
       COUNT(DISTINCT customer_unique_id) AS customers,
       CAST(SUM(merchandise_revenue) AS DOUBLE) / COUNT(*) AS average_order_value
FROM v_delivered GROUP BY customer_state"""

VIEWS["m_payment"] = """
SELECT dominant_payment_type, COUNT(*) AS orders, SUM(total_payment_value) AS amount_paid,
       AVG(maximum_installments) AS average_installments
FROM v_delivered GROUP BY dominant_payment_type"""

VIEWS["m_customer_state"] = """
SELECT customer_state, COUNT(*) AS customers, COUNT(*) FILTER (WHERE repeat_customer) AS repeat_customers,
       SUM(total_spend) AS customer_value, AVG(average_order_value) AS average_order_value,
       COUNT(*) FILTER (WHERE repeat_customer) / COUNT(*)::DOUBLE AS repeat_customer_rate
FROM m_features GROUP BY customer_state"""

VIEWS["m_delivery_state"] = """
SELECT customer_state, COUNT(*) AS orders, AVG(delivery_days) AS average_delivery_days,
       AVG(late_delivery) AS late_delivery_rate,
       CAST(SUM(total_freight_value) AS DOUBLE) / COUNT(*) AS average_freight,
       AVG(average_review_score) AS average_review
FROM v_delivered GROUP BY customer_state"""

VIEWS["m_delay_review"] = """
SELECT CASE late_delivery WHEN 1 THEN 'Late' ELSE 'On time or early' END AS delivery_status, COUNT(*) AS orders,
       AVG(review_score) AS average_review, AVG(delivery_delay_days) AS average_delay_days
FROM v_delivered WHERE review_score IS NOT NULL AND late_delivery IS NOT NULL GROUP BY 1"""

VIEWS["m_kpis"] = """
SELECT SUM(realized_merchandise_revenue) AS total_merchandise_revenue,
       COUNT(DISTINCT order_id) FILTER (WHERE order_status = 'delivered') AS total_delivered_orders,
       COUNT(DISTINCT customer_unique_id) FILTER (WHERE order_status = 'delivered') AS unique_customers,
       COALESCE(CAST(SUM(realized_merchandise_revenue) AS DOUBLE)
                / NULLIF(COUNT(*) FILTER (WHERE order_status = 'delivered'), 0), 0) AS average_order_value,
       SUM(item_count) FILTER (WHERE order_status = 'delivered') AS items_sold,
       AVG(average_review_score) FILTER (WHERE order_status = 'delivered') AS average_review_score,
       AVG(delivery_days) FILTER (WHERE order_status = 'delivered') AS average_delivery_days,
       AVG(late_delivery) FILTER (WHERE order_status = 'delivered') AS late_delivery_rate,
       (SELECT AVG(CAST(repeat_customer AS INT)) FROM m_features) AS repeat_customer_rate,
       AVG(CAST(order_status IN ('canceled', 'unavailable') AS INT)) AS cancellation_rate
FROM v_orders"""
