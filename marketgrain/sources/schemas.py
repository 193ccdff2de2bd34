"""Declared schemas and keys of the nine source tables."""

from __future__ import annotations

# Column names and their order are the source contract (fixed values); types follow the relational
# declaration of the tables. Dates are read as text so that unreadable ones can be counted.
SCHEMAS = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
    "customer_city string, customer_state string",
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
    "order_approved_at string, order_delivered_carrier_date string, order_delivered_customer_date string, "
    "order_estimated_delivery_date string",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
    "shipping_limit_date string, price decimal(12,2), freight_value decimal(12,2)",
    "payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, "
    "payment_value decimal(12,2)",
    "reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
    "review_comment_message string, review_creation_date string, review_answer_timestamp string",
    "products": "product_id string, product_category_name string, product_name_lenght double, "
    "product_description_lenght double, product_photos_qty double, product_weight_g double, "
    "product_length_cm double, product_height_cm double, product_width_cm double",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
    "geolocation_city string, geolocation_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
}

REQUIRED_COLUMNS = {
    table: [part.split()[0] for part in ddl.replace("(12,2)", "").split(", ")] for table, ddl in SCHEMAS.items()
}

# The columns that hold dates.
DATE_COLUMNS = {
    "orders": (
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ),
    "order_items": ("shipping_limit_date",),
    "reviews": ("review_creation_date", "review_answer_timestamp"),
}

# Keys that must be unique, and column sets that are known not to be keys.
UNIQUE_KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "order_items": ["order_id", "order_item_id"],
    "payments": ["order_id", "payment_sequential"],
    "reviews": ["review_id", "order_id"],
}
OBSERVED_KEYS = {
    "reviews": [["review_id"], ["order_id"]],
    "geolocation": [["geolocation_zip_code_prefix"]],
    "category_translation": [["product_category_name"]],
}

# Fixed values: (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
]

# Fixed values: (table, rule name, SQL condition that every row has to meet)
RANGE_RULES = [
    ("order_items", "price_not_negative", "price >= 0"),
    ("order_items", "freight_not_negative", "freight_value >= 0"),
    ("payments", "installments_not_negative", "payment_installments >= 0"),
    ("payments", "value_not_negative", "payment_value >= 0"),
    ("reviews", "score_between_1_and_5", "review_score BETWEEN 1 AND 5"),
]

# Columns that must be filled.
NOT_NULL = {
    "customers": [
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    ],
    "orders": [
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_estimated_delivery_date",
    ],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"],
    "payments": ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
    "reviews": ["review_id", "order_id", "review_score"],
    "products": ["product_id"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_state"],
}

# Names of the relational tables.
RELATIONAL_NAMES = {
    "customers": "customers",
    "orders": "orders",
    "order_items": "order_items",
    "payments": "order_payments",
    "reviews": "order_reviews",
    "products": "products",
    "sellers": "sellers",
    "geolocation": "geolocation",
    "category_translation": "product_category_translation",
}
