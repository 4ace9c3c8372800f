"""Fixed schemas of the invoice-line source and of the star schema tables."""

from __future__ import annotations

from pyspark.sql import types as T

INVOICE_LINES = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DecimalType(14, 4)),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)
"""Raw lines. CustomerID is a double because exports of nullable ids read ``17850.0``, and a
price has four digits because sources quote prices below a penny."""

RFM_REQUIRED = ("CustomerID", "InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice")
COHORT_REQUIRED = RFM_REQUIRED
BASKET_REQUIRED = ("CustomerID", "InvoiceNo", "Description", "Quantity", "UnitPrice")

AMOUNT = T.DecimalType(16, 4)
"""Quantity times price, without rounding."""

MONEY_UNITS = 10_000
"""Amounts as whole numbers of this fraction, where an integer key is needed."""

STAR_TYPES = {
    "dim_customers": {
        "customerid": "int",
        "recency": "int",
        "frequency": "int",
        "monetary": "decimal(12,2)",
        "r_score": "smallint",
        "f_score": "smallint",
        "m_score": "smallint",
        "rfm_total": "smallint",
        "rfm_score": "string",
        "segment": "string",
        "lastpurchasedate": "date",
        "avgordervalue": "decimal(12,2)",
    },
    "dim_products": {
        "stockcode": "string",
        "description": "string",
        "avgunitprice": "decimal(10,2)",
        "totalquantitysold": "int",
        "totalrevenue": "decimal(14,2)",
        "uniquecustomers": "int",
        "uniqueinvoices": "int",
        "popularityscore": "decimal(6,4)",
    },
    "dim_date": {
        "datekey": "date",
        "year": "smallint",
        "month": "smallint",
        "monthname": "string",
        "quarter": "smallint",
        "quartername": "string",
        "day": "smallint",
        "dayofweek": "smallint",
        "dayname": "string",
        "isweekend": "smallint",
        "yearmonth": "string",
        "yearquarter": "string",
    },
    "dim_geography": {
        "country": "string",
        "isuk": "smallint",
        "totalrevenue": "decimal(14,2)",
        "totalorders": "int",
        "uniquecustomers": "int",
        "avgordervalue": "decimal(10,2)",
        "revenuerank": "int",
    },
    "fact_transactions": {
        "customerid": "int",
        "stockcode": "string",
        "datekey": "date",
        "country": "string",
        "invoiceno": "string",
        "invoicedate": "timestamp_ntz",
        "quantity": "int",
        "unitprice": "decimal(10,2)",
        "totalamount": "decimal(12,2)",
        "year": "smallint",
        "month": "smallint",
        "quarter": "smallint",
        "dayofweek": "smallint",
        "isweekend": "smallint",
        "yearmonth": "string",
    },
}
"""Fixed values: column types of the published schema, applied when the tables are written."""
