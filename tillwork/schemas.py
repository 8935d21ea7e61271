"""Table schemas shared by sources, operators and tests."""

from pyspark.sql import types as T

# One row per source: a file, or a set of tables taken out of one document.
SOURCES = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("header", T.ArrayType(T.StringType())),
])

# One row per source row: cells still text, in the order of the source's header; NULL is missing.
RAW_CELLS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("row_ix", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

# One row per sale. The has_* flags say whether the source had such a column at all.
SALES = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("row_ix", T.LongType()),
    T.StructField("business_type", T.StringType()),
    T.StructField("sale_ts", T.TimestampNTZType()),
    T.StructField("item", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("order_ref", T.StringType()),
    T.StructField("order_name", T.StringType()),
    T.StructField("is_blank", T.BooleanType()),
    T.StructField("has_date", T.BooleanType()),
    T.StructField("has_total", T.BooleanType()),
    T.StructField("has_price", T.BooleanType()),
    T.StructField("has_qty", T.BooleanType()),
    T.StructField("has_item", T.BooleanType()),
    T.StructField("has_order", T.BooleanType()),
])

CLIENTS = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("business_type", T.StringType()),
    T.StructField("cadence", T.StringType()),
    T.StructField("last_file", T.StringType()),
    T.StructField("last_report", T.StringType()),
    T.StructField("onboarding_step", T.IntegerType()),
    T.StructField("history", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

SEEN_MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

# Nested message event, as posted by the chat platform.
EVENT = T.StructType([
    T.StructField("entry", T.ArrayType(T.StructType([
        T.StructField("changes", T.ArrayType(T.StructType([
            T.StructField("value", T.StructType([
                T.StructField("messages", T.ArrayType(T.StructType([
                    T.StructField("id", T.StringType()),
                    T.StructField("from", T.StringType()),
                    T.StructField("type", T.StringType()),
                    T.StructField("text", T.StructType([T.StructField("body", T.StringType())])),
                    T.StructField("document", T.StructType([
                        T.StructField("id", T.StringType()),
                        T.StructField("filename", T.StringType()),
                    ])),
                ]))),
            ])),
        ]))),
    ]))),
])
