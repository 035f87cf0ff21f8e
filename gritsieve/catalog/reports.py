"""The five business questions over the messy table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritsieve.catalog.base import date_sql, json_sql, messy, over_messy, query
from gritsieve.catalog.base import ORACLES
from gritsieve.functions.scalars import release_month
from gritsieve.functions.sql import quoted, register_functions
from gritsieve.plans import reports
from gritsieve.sources.files import text_view

c = F.col

_NUMBER = "try_cast(nullif(revenue, 'nan') AS DECIMAL(38,6))"
_PLAIN = r"'[0-9]+(\.[0-9]+)?'"


@query("qry_1", over_messy(f"SELECT row_id, title, revenue FROM (SELECT *, dense_rank() OVER (ORDER BY {_NUMBER} DESC) AS r FROM messy WHERE {_NUMBER} > 0) WHERE r = 3"))
def qry_1(spark, folder):
    return reports.nth_highest(messy(spark, folder).select("row_id", "title", "revenue"), "row_id", "revenue", 3)


_LOSSES = (
    f", losses AS (SELECT CAST(row_id AS VARCHAR) AS code, title, try_cast(revenue AS DECIMAL(38,6)) - try_cast(budget AS DECIMAL(38,6)) AS profit FROM messy "
    f"WHERE regexp_full_match(revenue, {_PLAIN}) AND regexp_full_match(budget, {_PLAIN}) AND try_cast(revenue AS DECIMAL(38,6)) < try_cast(budget AS DECIMAL(38,6))) "
)


@query(
    "qry_2",
    over_messy(
        f"{_LOSSES} SELECT 'worst' AS list, code, title, CAST(profit AS DOUBLE) AS profit FROM (SELECT * FROM losses ORDER BY profit, code LIMIT 10) "
        "UNION ALL SELECT 'first', code, title, CAST(profit AS DOUBLE) FROM (SELECT * FROM losses ORDER BY code LIMIT 3)"
    ),
)
def qry_2(spark, folder):
    df = messy(spark, folder).withColumn("code", c("row_id").cast("string"))
    lists = {
        "worst": reports.worst_losses(df, "code", "revenue", "budget", 10),
        "first": reports.first_losses(df, "code", "revenue", "budget", 3),
    }
    parts = [d.select(F.lit(n).alias("list"), "code", "title", c("profit").cast("double").alias("profit")) for n, d in lists.items()]
    return parts[0].unionByName(parts[1])


_ITEMS = f"lists AS (SELECT *, {json_sql('items')} AS j FROM messy), parts AS (SELECT row_id, revenue, day, unnest(json_extract(j, '$[*]')) AS e FROM lists WHERE json_type(j) = 'ARRAY')"
_NAMED = "json_extract_string(e, '$.id') AS id, json_extract_string(e, '$.name') AS name"


@query(
    "qry_3",
    over_messy(
        f", {_ITEMS} SELECT id, name, CAST(round(avg(try_cast(revenue AS DECIMAL(38,6)))) AS BIGINT) AS average "
        f"FROM (SELECT revenue, CAST(e AS VARCHAR) AS item, {_NAMED} FROM parts WHERE regexp_full_match(revenue, {_PLAIN})) GROUP BY item, id, name"
    ),
)
def qry_3(spark, folder):
    found = reports.average_by_item(messy(spark, folder), "items", "revenue")
    return found.select(F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.name").alias("name"), "average")


_LENGTH = f"CASE WHEN json_type({json_sql('items')}) = 'ARRAY' THEN json_array_length({json_sql('items')}) END"


@query(
    "qry_4",
    over_messy(
        f", lengths AS (SELECT {_LENGTH} AS n FROM messy) "
        "SELECT CAST(n AS BIGINT) AS n_items, count(*) AS \"count\", CAST(sum(count(*)) OVER (ORDER BY n) AS BIGINT) AS running FROM lengths WHERE n > 1 GROUP BY n"
    ),
)
def qry_4(spark, folder):
    found = reports.list_length_distribution(messy(spark, folder), "items")
    return found.withColumn("n_items", c("n_items").cast("bigint"))


@query(
    "qry_5",
    over_messy(
        f", {_ITEMS}, counts AS (SELECT month({date_sql('day')}) AS month, to_json(e) AS item, count(*) AS item_count, {_NAMED} FROM parts WHERE ({date_sql('day')}) IS NOT NULL GROUP BY ALL) "
        "SELECT month, id, name, item_count FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY item_count DESC, "
        "CASE WHEN name IS NULL THEN '{\"id\":' || id || ',\"name\":null}' ELSE '{\"id\":' || id || ',\"name\":\"' || name || '\"}' END) AS rn FROM counts) WHERE rn = 1"
    ),
)
def qry_5(spark, folder):
    found = reports.top_item_per_month(messy(spark, folder), "items", release_month(c("day")).cast("bigint"))
    return found.select(
        "month", F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.name").alias("name"), "item_count"
    )


def _asked(spark, folder, sql: str):
    """A question in SQL text over the raw view."""
    register_functions(spark)
    text_view(messy(spark, folder), "raw_text")
    return spark.sql(sql)


@query("qry_3_sql", ORACLES["qry_3"])
def qry_3_sql(spark, folder):
    return _asked(
        spark,
        folder,
        "SELECT get_json_object(item, '$.id') AS id, get_json_object(item, '$.name') AS name, CAST(round(avg(amount)) AS BIGINT) AS average "
        "FROM (SELECT item, to_amount(revenue) AS amount FROM raw_text, LATERAL list_items(items) "
        f"WHERE revenue RLIKE {quoted(reports.AMOUNT_TEXT)}) GROUP BY item",
    )


@query("qry_5_sql", ORACLES["qry_5"])
def qry_5_sql(spark, folder):
    return _asked(
        spark,
        folder,
        "WITH named AS (SELECT month(extract_ymd_datetime(day)) AS month, item FROM raw_text, LATERAL list_items(items)), "
        "counts AS (SELECT CAST(month AS BIGINT) AS month, item, count(*) AS item_count FROM named WHERE month IS NOT NULL GROUP BY ALL) "
        "SELECT month, get_json_object(item, '$.id') AS id, get_json_object(item, '$.name') AS name, item_count "
        "FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY item_count DESC, item) AS place FROM counts) WHERE place = 1",
    )
