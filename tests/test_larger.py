"""Registered queries against their SQL on tables with more rows a group than the given ones."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_contract import compare
from sparkdrift.operators import registry as R
from sparkdrift.operators.transform import to_storage
from sparkdrift.plans import models as P
from sparkdrift.sources import table as S

# Events of an hour: more than a percentage column holds, and halves that only exact products keep.
BUSY = {"click": 1600, "view": 65, "error": 105, "signup": 5}


@pytest.fixture(scope="module")
def busy(tmp_path_factory):
    """Folder with events that crowd into two hours, on both sides of the later deliveries' start."""
    folder = tmp_path_factory.mktemp("busy")
    counts = " UNION ALL ".join(f"SELECT '{kind}' AS event_type, {n} AS n" for kind, n in BUSY.items())
    duckdb.sql(f"""COPY (
      SELECT row_number() OVER (ORDER BY day, event_type, i) AS event_id,
        TIMESTAMP '2024-01-15 07:00:00' + to_days(CAST(day AS INTEGER)) + to_seconds(i) AS ts,
        i AS user_id, event_type, round(i % 97 + 0.37, 2) AS value, '{{}}' AS props
      FROM (SELECT event_type, unnest(range(n)) AS i FROM ({counts})), (SELECT unnest([0, 5]) AS day)
    ) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


def same_as_sql(spark, folder, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = contract.queries()[name](spark, folder).toPandas()
    return compare(got, connection.execute(contract.oracle_sql()[name]).df())


def test_table_roundtrip_of_busy_hours(spark, busy):
    assert same_as_sql(spark, busy, "table_roundtrip") is None


def test_partial_columns_of_busy_hours(spark, busy):
    assert same_as_sql(spark, busy, "upsert_partial_columns") is None


def hour_of_events(folder, n, value):
    """Events table of ``n`` clicks in one hour before the later deliveries' start and ``n`` views after it."""
    duckdb.sql(f"""COPY (
      SELECT day * {n} + i AS event_id,
        TIMESTAMP '2024-01-15 07:00:00' + to_days(CAST(day AS INTEGER)) + to_microseconds(i) AS ts,
        i AS user_id, CASE day WHEN 0 THEN 'click' ELSE 'view' END AS event_type, {value} AS value, '{{}}' AS props
      FROM (SELECT unnest(range({n})) AS i), (SELECT unnest([0, 5]) AS day)
    ) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


def test_partial_columns_of_a_million_events_an_hour(spark, tmp_path):
    folder = hour_of_events(tmp_path, 1000003, "round(i % 97 + 0.37, 2)")
    assert same_as_sql(spark, folder, "upsert_partial_columns") is None


@pytest.mark.parametrize("name", ["upsert_partial_columns", "table_roundtrip", "upsert_batch_order"])
def test_values_beyond_weather(spark, tmp_path, name):
    folder = hour_of_events(tmp_path, 3, "i + 123456.78::DOUBLE")
    assert same_as_sql(spark, folder, name) is None


def test_a_table_keeps_its_types(spark, tmp_path):
    path = str(tmp_path / "table")
    row = spark.sql(
        "SELECT 40.5D AS latitude, 7D AS longitude, TIMESTAMP '2024-01-15 07:00:00' AS timestamp, "
        "1000000D AS precipitation, TIMESTAMP '2024-02-01' AS updated_at"
    )
    rows = S.prepare_rows(row, "b1")
    with pytest.raises(ArithmeticException):  # the default types are the reference's
        S.upsert(spark, path, rows)
    S.upsert(spark, path, rows, decimals=S.DECIMALS | {"precipitation": (18, 2)})
    with pytest.raises(S.TableTypeError, match="precipitation"):
        S.upsert(spark, path, rows.withColumn("precipitation", F.lit(1.0)))
    assert [r["precipitation"] for r in S.from_table_types(spark.read.parquet(path)).collect()] == [1e6]


def test_storage_of_busy_hours(spark, busy):
    assert same_as_sql(spark, busy, "to_storage") is None


def test_decimals_round_half_even_as_they_are(spark):
    # As doubles 8.345 * 100 is 834.5000000000001 and 65 * 1.37 * 10 is 890.5000000000001.
    df = spark.sql("SELECT 8.345BD AS temperature, 65 * 1.37BD AS humidity, CAST(NULL AS DECIMAL(5, 2)) AS pressure")
    row = to_storage(df, "api", "b1").first()
    assert (row["temperature_2m"], row["relative_humidity_2m"], row["surface_pressure"]) == (8.34, 89.0, None)
    assert row["raw_data"] == '{"temperature_2m":8.34,"relative_humidity_2m":89.0,"surface_pressure":null}'


def test_a_production_run_is_not_better_than_itself(spark):
    # Every reading of these metrics differs in the last digits, as sums over a cluster do.
    unsteady = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    runs = spark.range(40).select(F.format_string("r%s", "id").alias("run_id"), F.lit(3.0).alias("test_rmse"), F.lit(2.0).alias("test_mae"))
    metrics = runs.withColumn("test_rmse", unsteady("test_rmse")).unpivot(["run_id"], ["test_rmse", "test_mae"], "key", "value")
    model, stage = F.concat(F.lit("m"), "run_id"), F.lit("Production")
    versions = runs.select(model.alias("model_name"), F.lit(7).cast("long").alias("version"), stage.alias("stage"), "run_id")
    rows = R.compare_production(versions.select("model_name", "run_id"), versions, metrics).collect()
    assert [(r["is_better"], r["reason"]) for r in rows] == [(False, "compared")] * 40
    assert all(r["new_rmse"] == r["production_rmse"] for r in rows)


def test_trees_fit_on_even_parts(spark, monkeypatch):
    # As windows leave them: many parts, nearly all rows in three of them.
    rows = spark.range(3000).select((F.col("id") % 3).alias("s"), F.col("id").cast("double").alias("a"), (F.col("id") % 7 * 1.0).alias("y"))
    uneven = rows.repartition(64, "s")
    seen, create = [], P.create_model

    def spy(kind, vectors, label, **params):
        seen.append(sorted(vectors.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()))
        return create(kind, vectors, label, **params)

    monkeypatch.setattr(P, "create_model", spy)
    P.fit_model("gradient_boosting", uneven, ["a"], "y", rounds=1)
    P.fit_model("random_forest", uneven, ["a"], "y", trees=1)
    assert seen == [[3000], [3000]]
    dealt = P.deal_evenly(uneven, ["y", "a"], rows_per_task=500)
    sizes = dealt.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 6 and sum(sizes) == 3000 and max(sizes) <= 1.1 * min(sizes)
    assert dealt.exceptAll(rows).count() == 0
    assert P.deal_evenly(rows.where("a < 0"), ["y"]).count() == 0
