"""Declared schemas. Nothing in the package is schema-inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Output column order and names of a product row.
PRODUCT_FIELDS = {
    "title": "Listing Title*",
    "url": "Listings URL*",
    "image_url": "Image URL*",
    "marketplace": "Marketplace*",
    "price": "Price*",
    "shipping": "Shipping",
    "units": "Units Available",
    "item_number": "Item Number",
    "brand": "Brand",
    "asin": "ASIN",
    "upc": "UPC",
    "walmart_id": "Walmart ID",
    "seller_name": "Seller's Name*",
    "seller_url": "Seller's URL*",
    "seller_business": "Seller's Business Name",
    "seller_address": "Seller's Address",
    "seller_email": "Seller's Email",
    "seller_phone": "Seller's Phone Number",
}
PRODUCT_COLUMNS = list(PRODUCT_FIELDS)

# Where a product row came from; carried beside the 18 fields.
ORIGIN_COLUMNS = ["keyword", "page_no", "pos"]

PRODUCT = T.StructType([T.StructField(c, T.StringType(), False) for c in PRODUCT_COLUMNS])

# A product row with its origin.
FOUND = T.StructType(
    [
        T.StructField("keyword", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in PRODUCT_COLUMNS],
    ]
)

# A product as stored in an artefact file (header names, text only).
ARTEFACT = T.StructType([T.StructField(n, T.StringType()) for n in PRODUCT_FIELDS.values()])

LISTING_PAGES = T.StructType(
    [
        T.StructField("keyword", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("html", T.StringType()),
    ]
)

DETAIL_PAGES = T.StructType(
    [T.StructField("clean_url", T.StringType()), T.StructField("html", T.StringType())]
)

ENVELOPE = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(T.StructType([T.StructField("content", T.StringType())])),
        ),
        T.StructField("unreadable", T.StringType()),
    ]
)

JOB_EVENTS = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Dead letters as stored: instants are ISO-8601 text.
DEAD_LETTERS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempt_count", T.IntegerType()),
        T.StructField("last_attempt", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("next_retry_at", T.StringType()),
    ]
)

# Commits of artefacts, beside the artefacts.
CATALOGUE_FOLDER = "catalogue"
CATALOGUE = T.StructType(
    [
        T.StructField("output_name", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("products", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
    ]
)

JOB_STATUSES = ["pending", "running", "completed", "failed", "retrying", "dead_letter"]
TERMINAL_STATUSES = ["completed", "failed", "dead_letter"]
