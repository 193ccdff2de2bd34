"""SQL counterparts of the thirty questions."""

from registry.portable import portable_sql
from registry.views import VIEWS

_SHARED = {
    **VIEWS,
    "t_delivered": "SELECT c_orders.*, customer_unique_id, customer_state, CAST(date_trunc('month', bought) AS TIMESTAMP) "
    "AS month FROM c_orders JOIN c_customers USING (customer_id) WHERE order_status = 'delivered'",
    "t_sold": "SELECT c_items.*, t_delivered.* EXCLUDE (order_id), category "
    "FROM c_items JOIN t_delivered USING (order_id) JOIN c_products USING (product_id)",
    "t_people": "SELECT customer_unique_id, COUNT(*) AS orders FROM c_orders JOIN c_customers USING (customer_id) "
    "GROUP BY 1",
    "t_arrived": "SELECT *, CAST(arrived > promised AS INT) AS late FROM t_delivered WHERE arrived IS NOT NULL",
    "t_category": "SELECT category, SUM(price) AS revenue FROM t_sold GROUP BY 1",
    "t_months": "SELECT month, SUM(price) AS revenue FROM t_sold GROUP BY 1",
    "t_active": "SELECT DISTINCT customer_unique_id, month FROM t_delivered",
}

_QUESTIONS = {
    "q01": ("merchandise_revenue:m", "SELECT SUM(price) AS merchandise_revenue FROM t_sold"),
    "q02": ("delivered_orders:l", "SELECT COUNT(*) AS delivered_orders FROM t_delivered"),
    "q03": ("unique_customers:l", "SELECT COUNT(DISTINCT customer_unique_id) AS unique_customers FROM t_delivered"),
    "q04": (
        "average_order_value:d",
        "SELECT CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS average_order_value FROM t_sold",
    ),
    "q05": ("month:t merchandise_revenue:m", "SELECT month, revenue AS merchandise_revenue FROM t_months"),
    "q06": ("month:t orders:l", "SELECT month, COUNT(*) AS orders FROM t_delivered GROUP BY 1"),
    "q07": (
        "month:t revenue:m revenue_growth:d",
        """SELECT month, revenue, CAST(revenue - b AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0) AS revenue_growth
           FROM (SELECT *, LAG(revenue) OVER (ORDER BY month) AS b FROM t_months)""",
    ),
    "q08": (
        "category:s merchandise_revenue:m",
        "SELECT category, revenue AS merchandise_revenue FROM t_category ORDER BY revenue DESC, category LIMIT 15",
    ),
    "q09": (
        "category:s orders:l",
        "SELECT category, COUNT(DISTINCT order_id) AS orders FROM t_sold GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    ),
    "q10": (
        "seller_id:l orders:l merchandise_revenue:m",
        """SELECT seller_id, COUNT(DISTINCT order_id) AS orders, SUM(price) AS merchandise_revenue
           FROM t_sold GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""",
    ),
    "q11": (
        "category:s reviewed_orders:l average_review:d",
        """SELECT category, COUNT(*) AS reviewed_orders, AVG(review_score) AS average_review
           FROM (SELECT DISTINCT order_id, category FROM c_items JOIN c_products USING (product_id))
           JOIN g_latest USING (order_id) GROUP BY category HAVING reviewed_orders >= 100""",
    ),
    "q12": (
        "customer_state:s customers:l",
        "SELECT customer_state, COUNT(DISTINCT customer_unique_id) AS customers FROM c_customers GROUP BY 1",
    ),
    "q13": (
        "customer_state:s merchandise_revenue:m",
        "SELECT customer_state, SUM(price) AS merchandise_revenue FROM t_sold GROUP BY 1",
    ),
    "q14": (
        "repeat_customer_rate:d",
        "SELECT COUNT(*) FILTER (WHERE orders > 1) / COUNT(*)::DOUBLE AS repeat_customer_rate FROM t_people",
    ),
    "q15": (
        "payment_type:s payment_records:l amount_paid:m",
        """SELECT payment_type, COUNT(*) AS payment_records, SUM(payment_value) AS amount_paid
           FROM c_payments GROUP BY 1""",
    ),
    "q16": (
        "payment_type:s payment_installments:l payments:l average_payment:d",
        """SELECT payment_type, payment_installments, COUNT(*) AS payments,
                  CAST(SUM(payment_value) AS DOUBLE) / COUNT(*) AS average_payment
           FROM c_payments GROUP BY 1, 2""",
    ),
    "q17": (
        "average_delivery_days:d",
        "SELECT AVG(EXTRACT(EPOCH FROM arrived - bought) / 86400.0) AS average_delivery_days FROM t_arrived",
    ),
    "q18": ("late_delivery_rate:d", "SELECT AVG(late) AS late_delivery_rate FROM t_arrived"),
    "q19": (
        "customer_state:s delivered_orders:l late_delivery_rate:d",
        """SELECT customer_state, COUNT(*) AS delivered_orders, AVG(late) AS late_delivery_rate
           FROM t_arrived GROUP BY 1""",
    ),
    "q20": ("review_score:l reviews:l", "SELECT review_score, COUNT(*) AS reviews FROM c_reviews GROUP BY 1"),
    "q21": (
        "delivery_status:s orders:l average_review:d",
        """SELECT CASE late WHEN 1 THEN 'Late' ELSE 'On time or early' END AS delivery_status, COUNT(*) AS orders,
                  AVG(review_score) AS average_review
           FROM t_arrived JOIN g_latest USING (order_id) GROUP BY 1""",
    ),
    "q22": (
        "freight_to_merchandise_ratio:d",
        """SELECT CAST(SUM(freight_value) AS DOUBLE) / CAST(SUM(price) AS DOUBLE) AS freight_to_merchandise_ratio
           FROM t_sold""",
    ),
    "q23": (
        "customer_unique_id:l orders:l historical_spend:m",
        """SELECT customer_unique_id, COUNT(DISTINCT order_id) AS orders, SUM(price) AS historical_spend
           FROM t_sold GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100""",
    ),
    "q24": (
        "seller_id:l orders:l revenue:m average_review:d late_delivery_rate:d",
        """SELECT seller_id, COUNT(*) AS orders, SUM(r) AS revenue, AVG(review_score) AS average_review,
                  AVG(COALESCE(CAST(arrived > promised AS INT), 0)) AS late_delivery_rate
           FROM (SELECT seller_id, order_id, SUM(price) AS r FROM c_items GROUP BY 1, 2)
           JOIN t_delivered USING (order_id) LEFT JOIN g_latest USING (order_id) GROUP BY 1""",
    ),
    "q25": (
        "month:t order_status:s orders:l",
        """SELECT CAST(date_trunc('month', bought) AS TIMESTAMP) AS month, order_status, COUNT(*) AS orders
           FROM c_orders WHERE order_status = 'canceled' OR order_status = 'unavailable' GROUP BY 1, 2""",
    ),
    "q26": (
        "category:s revenue:m share:d cumulative_share:d",
        """SELECT category, revenue, CAST(revenue AS DOUBLE) / CAST(SUM(revenue) OVER () AS DOUBLE) AS share,
                  CAST((SELECT SUM(revenue) FROM t_category b WHERE b.revenue >= a.revenue) AS DOUBLE)
                  / CAST(SUM(revenue) OVER () AS DOUBLE) AS cumulative_share
           FROM t_category a""",
    ),
    "q27": (
        "customer_unique_id:l products:l categories:l",
        """SELECT customer_unique_id, COUNT(DISTINCT product_id) AS products, COUNT(DISTINCT category) AS categories
           FROM t_sold GROUP BY 1""",
    ),
    "q28": (
        "year:l category:s revenue:m revenue_rank:l",
        """SELECT year, category, revenue, dense_rank() OVER (PARTITION BY year ORDER BY revenue DESC) AS revenue_rank
           FROM (SELECT year(bought) AS year, category, SUM(price) AS revenue FROM t_sold GROUP BY 1, 2)""",
    ),
    "q29": ("orders:l customers:l", "SELECT orders, COUNT(*) AS customers FROM t_people GROUP BY 1"),
    "q30": (
        "cohort_month:t order_month:t cohort_index:l active_customers:l",
        """SELECT cohort_month, month AS order_month, datediff('month', cohort_month, month) AS cohort_index,
                  COUNT(*) AS active_customers
           FROM t_active JOIN (SELECT customer_unique_id, MIN(month) AS cohort_month FROM t_active GROUP BY 1)
             USING (customer_unique_id)
           GROUP BY ALL""",
    ),
}

ORACLES = {name: portable_sql(_SHARED, spec, body) for name, (spec, body) in _QUESTIONS.items()}
