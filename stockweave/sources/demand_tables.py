"""Demand tables derived from the star-schema test data (see FIXTURES.md, part 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_items(spark: SparkSession, sf_dir: str, *part_columns: str) -> DataFrame:
    """Line items with the nation of their supplier and columns of their part. Dimension joins
    carry no hint: Spark broadcasts them only when their measured size allows it."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", *part_columns)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (line.join(part, line.l_partkey == part.p_partkey)
                .join(supplier, line.l_suppkey == supplier.s_suppkey)
                .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))


def _day_measures() -> list:
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return [F.sum("l_quantity").alias("quantity_sold"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            (F.max("l_discount") * 100).alias("discount"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0))
             .alias("received_stock"),
            F.sum(F.when(returned, 0.0).otherwise(F.col("l_quantity"))).alias("closing_stock")]


def daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and stock per nation, part type and ship day.

    The grouping is partially aggregated before its shuffle, so a nation or part that holds
    a large share of the line items is reduced to one row per day first.
    """
    return _line_items(spark, sf_dir, "p_type").groupBy(
        F.col("n_name").alias("outlet_id"), F.col("p_type").alias("product_id"),
        F.to_date("l_shipdate").alias("date")).agg(*_day_measures())


def supply_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of `daily_facts` per nation, part type, brand and ship day, stored: one scan of
    the line items from which both the facts and the stock of supply items are rolled up."""
    return cut(_line_items(spark, sf_dir, "p_type", "p_brand").groupBy(
        F.col("n_name").alias("outlet_id"), F.col("p_type").alias("product_id"), F.col("p_brand").alias("supply_product_id"),
        F.to_date("l_shipdate").alias("date")).agg(*_day_measures()))


def facts_of(cube: DataFrame) -> DataFrame:
    """`daily_facts` from the cube."""
    return cube.groupBy("outlet_id", "product_id", "date").agg(
        F.sum("quantity_sold").alias("quantity_sold"), F.sum("revenue").alias("revenue"), F.max("discount").alias("discount"),
        F.sum("received_stock").alias("received_stock"), F.sum("closing_stock").alias("closing_stock"))


def stock_of(cube: DataFrame) -> DataFrame:
    """Stock per nation, brand and day from the cube."""
    return cube.groupBy("outlet_id", F.col("supply_product_id").alias("product_id"), "date").agg(
        F.sum("received_stock").alias("received_stock"), F.sum("closing_stock").alias("closing_stock"))


def sales(facts: DataFrame) -> DataFrame:
    return facts.select("outlet_id", "product_id", "date", "quantity_sold", "revenue")


def inventory(facts: DataFrame) -> DataFrame:
    return facts.select("outlet_id", "product_id", "date", "received_stock", "closing_stock",
                        (F.col("closing_stock") == 0).alias("stockout"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense daily series per user group and event type."""
    return (table(spark, sf_dir, "events")
            .groupBy(F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("outlet_id"),
                     F.col("event_type").alias("product_id"), F.to_date("ts").alias("date"))
            .agg(F.sum("value").alias("quantity_sold")))


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outlet per nation with attributes derived from its key."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")

    def pick(labels, shift=0):
        return F.element_at(F.array(*[F.lit(x) for x in labels]), ((key + shift) % len(labels) + 1).cast("int"))

    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                F.col("n_name").alias("outlet_id"),
                F.col("n_name").alias("name"),
                pick(["cafe", "bistro", "bakery", "diner", "kiosk"]).alias("outlet_type"),
                F.col("r_name").alias("country"), F.col("r_name").alias("region"),
                F.col("n_name").alias("city"),
                pick(["center", "suburb", "campus", "coast", "station"]).alias("location_type"),
                F.when(key % 3 == 0, F.lit("mixed")).alias("cuisine"),
                (30 + 10 * key).alias("capacity"),
                (key % 2 == 0).alias("delivery_available"),
                (key % 2 == 1).alias("takeaway_available"),
                (key % 3 == 0).alias("bar_available"),
                pick(["open", "closed", "shared"]).alias("kitchen_type"),
                ((key % 10) / 10.0).alias("tourism_level"),
                (((key + 3) % 10) / 10.0).alias("business_area"),
                (((key + 5) % 10) / 10.0).alias("residential_area"),
                (((key + 7) % 10) / 10.0).alias("student_area"),
                (((key * 7) % 180) - 90.0).alias("latitude"),
                (((key * 15) % 360) - 180.0).alias("longitude")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").select(F.col("p_type").alias("product_id")).distinct()
            .select("product_id", F.col("product_id").alias("name"),
                    F.lit("parts").alias("category"), F.lit("pieces").alias("unit")))


def calendar_days(facts: DataFrame) -> DataFrame:
    """One context row per outlet and day that has a fact."""
    return (facts.groupBy("outlet_id", "date").agg(F.max("discount").alias("discount"))
            .select("outlet_id", "date",
                    F.when((F.month("date") == 12) & (F.dayofmonth("date") == 25), 1.0).otherwise(0.0)
                     .alias("holiday_importance"),
                    F.when((F.month("date") == 12) & (F.dayofmonth("date") <= 26), 0.5).otherwise(0.0)
                     .alias("religious_score"),
                    F.when(F.dayofmonth("date") == 1, 0.4).otherwise(0.0).alias("event_strength"),
                    (F.col("discount") >= 9).cast("int").alias("promotion_active"),
                    (F.dayofmonth("date") % 5 == 0).cast("int").alias("is_rainy")))


def demographics(outlet_table: DataFrame) -> DataFrame:
    return outlet_table.select(
        "outlet_id",
        (F.col("capacity") * 1.0).alias("population_density"),
        F.col("tourism_level").alias("tourism_index"),
        F.col("student_area").alias("student_index"),
        F.col("business_area").alias("business_index"),
        F.col("residential_area").alias("residential_index"),
        (1.0 - F.col("tourism_level")).alias("religious_population_share"),
        F.lit(0.3).alias("young_population_share"),
        F.col("business_area").alias("working_population_share"))


def context_facts(facts: DataFrame) -> DataFrame:
    """Facts with a deterministic context per day, for spike and feature operators."""
    day, month = F.dayofmonth("date"), F.month("date")
    return facts.withColumns({
        "temperature": 15.0 + 10.0 * (month % 7) - (day % 9),
        "precipitation": F.when(day % 5 == 0, 2.5).otherwise(0.0),
        "holiday_importance": F.when((month == 12) & (day == 25), 1.0).otherwise(0.0),
        "event_active": F.when(day == 1, 1.0).otherwise(0.0),
    })


def _brand_number(column):
    return F.regexp_extract(column, "([0-9]+)", 1).cast("int")


def bill_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return (table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
            .select(F.col("p_type").alias("product_id"), brand.alias("supply_product_id"),
                    (1.0 + (_brand_number(brand) % 4) * 0.25).alias("quantity_per_unit"),
                    F.lit("pieces").alias("supply_unit")))


def supplier_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return (table(spark, sf_dir, "part").select("p_brand").distinct()
            .select(brand.alias("supply_product_id"), F.concat(F.lit("S-"), brand).alias("supplier_id"),
                    (1 + _brand_number(brand) % 5).alias("lead_time_days"),
                    F.lit(5.0).alias("minimum_order_quantity"), F.lit(5.0).alias("order_multiple")))
