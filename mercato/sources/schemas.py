"""Explicit schemas of the eight raw tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(12, 2)
STRING, INT, MOMENT = T.StringType(), T.IntegerType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW_SCHEMAS = {
    "orders": _schema(
        order_id=STRING,
        customer_id=STRING,
        order_status=STRING,
        order_purchase_timestamp=MOMENT,
        order_approved_at=MOMENT,
        order_delivered_carrier_date=MOMENT,
        order_delivered_customer_date=MOMENT,
        order_estimated_delivery_date=MOMENT,
    ),
    "customers": _schema(
        customer_id=STRING,
        customer_unique_id=STRING,
        customer_city=STRING,
        customer_state=STRING,
    ),
    "items": _schema(
        order_id=STRING,
        order_item_id=INT,
        product_id=STRING,
        seller_id=STRING,
        price=AMOUNT,
        freight_value=AMOUNT,
    ),
    "payments": _schema(
        order_id=STRING,
        payment_type=STRING,
        payment_installments=INT,
        payment_value=AMOUNT,
    ),
    "reviews": _schema(order_id=STRING, review_score=INT),
    "products": _schema(
        product_id=STRING,
        product_category_name=STRING,
        product_weight_g=INT,
        product_length_cm=INT,
        product_width_cm=INT,
        product_height_cm=INT,
    ),
    "translation": _schema(
        product_category_name=STRING, product_category_name_english=STRING
    ),
    "sellers": _schema(seller_id=STRING, seller_city=STRING, seller_state=STRING),
}
RAW_TABLES = tuple(RAW_SCHEMAS)
