from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_star_and_reports import some_lines
from tillgrain.operators.star import Star, touched_months, within_months
from tillgrain.sources.versions import Conflict, Refresh, Store

SCHEMA = "year int, month smallint, shop string, v bigint"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def frame(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def load(spark, store):
    change = store.refresh()
    change.replace_partitions("sales", frame(spark, (2011, 1, "a/b c", 1), (2011, 2, "x", 2), (2011, 2, None, 3)), ["year", "month"], [(2011, 1), (2011, 2)])
    change.replace("shops", frame(spark, (0, 0, "x", 9)))
    return change.publish()


def test_only_touched_partitions_change(spark, store):
    assert store.versions() == [] and load(spark, store) == 1
    change = store.refresh()
    change.replace_partitions("sales", frame(spark, (2011, 2, "x", 20), (2011, 3, "y", 30)), ["year", "month"], [(2011, 2), (2011, 3)])
    assert change.publish() == 2
    assert rows(store.table("sales"), "year", "month", "v") == [(2011, 1, 1), (2011, 2, 20), (2011, 3, 30)]
    assert rows(store.table("sales", 1), "month", "v") == [(1, 1), (2, 2), (2, 3)]
    assert store.parts("sales") == {"year=2011/month=1": 1, "year=2011/month=2": 2, "year=2011/month=3": 2}
    assert rows(store.table("shops"), "v") == [(9,)]
    assert dict(store.table("sales").dtypes) == {"year": "int", "month": "smallint", "shop": "string", "v": "bigint"}
    plan = store.table("sales").filter("month = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_touched_partition_may_become_empty_and_others_may_not_change(spark, store):
    load(spark, store)
    change = store.refresh()
    change.replace_partitions("sales", frame(spark), ["year", "month"], [(2011, 2)])
    change.publish()
    assert rows(store.table("sales"), "month") == [(1,)]
    with pytest.raises(Exception, match="outside the touched partitions"):
        store.refresh().replace_partitions("sales", frame(spark, (2011, 1, "a", 1)), ["year", "month"], [(2011, 2)])
    with pytest.raises(ValueError):
        store.refresh().replace_partitions("sales", frame(spark), ["year"], [(2011,)])
    with pytest.raises(LookupError):
        store.table("nothing")


def test_partition_names_are_escaped(spark, store):
    change = store.refresh()
    values = [(1, 1, "a/b c=d%", 1), (1, 1, None, 2), (1, 1, "plain", 3)]
    change.replace_partitions("t", frame(spark, *values), ["shop"], [("a/b c=d%",), (None,), ("plain",)])
    change.publish()
    change = store.refresh()
    change.replace_partitions("t", frame(spark, (1, 1, None, 20)), ["shop"], [("a/b c=d%",), (None,)])
    change.publish()
    assert rows(store.table("t"), "shop", "v") == [("plain", 3), (None, 20)]


def test_a_refresh_that_dies_is_never_seen(spark, store):
    load(spark, store)
    before = rows(store.table("sales")), rows(store.table("shops"))
    dead = store.refresh()
    dead.replace_partitions("sales", frame(spark, (2011, 1, "half", 7)), ["year", "month"], [(2011, 1)])
    assert (rows(store.table("sales")), rows(store.table("shops"))) == before
    with pytest.raises(Exception, match="torn"):
        bad = frame(spark, (2011, 1, "q", 1)).withColumn("v", F.raise_error(F.lit("torn")).cast("bigint"))
        dead.replace("shops", bad)
    assert (rows(store.table("sales")), rows(store.table("shops"))) == before
    again = store.refresh()  # takes the same version and none of the dead files
    again.replace_partitions("sales", frame(spark, (2011, 2, "whole", 8)), ["year", "month"], [(2011, 2), (2011, 1)])
    assert again.publish() == 2
    assert rows(store.table("sales"), "shop") == [("whole",)]


def test_of_two_refreshes_one_is_refused(spark, store):
    load(spark, store)
    first, second = store.refresh(), store.refresh()
    first.replace("shops", frame(spark, (0, 0, "first", 1)))
    second.replace("shops", frame(spark, (0, 0, "second", 2)))
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    with pytest.raises(Conflict):  # also when both have passed the check
        store._publish(second.next)
    assert rows(store.table("shops"), "shop") == [("first",)]


def test_vacuum_keeps_what_is_read(spark, store):
    load(spark, store)
    store.refresh().replace("shops", frame(spark, (0, 0, "dead", 1)))
    for v in (2, 3):
        change = store.refresh()
        change.replace_partitions("sales", frame(spark, (2011, 2, "x", v)), ["year", "month"], [(2011, 2)])
        change.publish()
    assert store.vacuum(keep=2) == 2  # the dead one and the first second month
    assert store.versions() == [2, 3]
    assert rows(store.table("sales", 2), "v") == [(1,), (2,)]
    assert rows(store.table("sales"), "v") == [(1,), (3,)]
    assert rows(store.table("shops"), "v") == [(9,)]


def test_star_refresh_killed_midway(spark, store, make_sales, monkeypatch):
    lines = some_lines(make_sales)
    Star.build(lines).refresh(store)
    old = Star.at(store)
    before = rows(old.fact_transactions), rows(old.dim_customers)
    doubled = lines.withColumn("TotalAmount", F.col("TotalAmount") * 2)
    months = touched_months(old.fact_transactions)[:1]
    write, calls = Refresh._write, []

    def dies(self, name, *rest):
        calls.append(name)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return write(self, name, *rest)

    monkeypatch.setattr(Refresh, "_write", dies)
    with pytest.raises(KeyboardInterrupt):
        Star.build(doubled).refresh(store, months)
    now = Star.at(store)
    assert (rows(now.fact_transactions), rows(now.dim_customers)) == before
    monkeypatch.undo()
    Star.build(doubled).refresh(store, months)
    sums = {(r.year, r.month): r.s for r in Star.at(store).fact_transactions.groupBy("year", "month").agg(F.sum("totalamount").alias("s")).collect()}
    first = {(r.year, r.month): r.s for r in old.fact_transactions.groupBy("year", "month").agg(F.sum("totalamount").alias("s")).collect()}
    assert sums == {k: v * 2 if k in months else v for k, v in first.items()}
    assert (rows(old.fact_transactions), rows(old.dim_customers)) == before  # readers of the old version go on


def test_months_as_ranges(spark):
    days = spark.sql("SELECT explode(sequence(date'2010-11-15', date'2011-04-15', interval 1 month)) AS d").select(F.col("d").cast("timestamp_ntz").alias("d"))
    kept = days.filter(within_months(F.col("d"), [(2010, 12), (2011, 1), (2011, 3)]))
    assert rows(kept.select(F.date_format("d", "yyyy-MM"))) == [("2010-12",), ("2011-01",), ("2011-03",)]
    assert days.filter(within_months(F.col("d"), [])).count() == 0
