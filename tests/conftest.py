from __future__ import annotations

import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillgrain.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LINE_SCHEMA = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, "
    "InvoiceDate timestamp_ntz, UnitPrice decimal(10,2), CustomerID bigint, Country string"
)


@pytest.fixture
def make_lines(spark):
    """Sales lines from tuples (invoice, product, text, quantity, 'yyyy-mm-dd hh:mm', price, customer, country)."""

    def make(*rows):
        return spark.createDataFrame(
            [
                (inv, sku, text, qty, datetime.fromisoformat(when), Decimal(str(price)), cust, land)
                for inv, sku, text, qty, when, price, cust, land in rows
            ],
            LINE_SCHEMA,
        )

    return make


@pytest.fixture
def make_sales(make_lines):
    from tillgrain.sources.readers import with_total_amount

    return lambda *rows: with_total_amount(make_lines(*rows))


def rows(df, *columns):
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
