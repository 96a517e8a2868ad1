"""Queries: the streaming ingest of client files written from the orders."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import demand_tables as src
from ..streaming import ingest
from .lineage import shared_folder
from .registry import cte, query

# Seven clients send the orders of their customers, each in a layout of its own; two send files that must be refused.
CLIENTS = 7
cte("sent", f"""
SELECT 'client' || (o_custkey % {CLIENTS}) AS client, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, 'C' || (o_custkey % 40) AS outlet_id,
  o_orderpriority || '"' AS product_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END AS quantity_sold
FROM orders""")
cte("judged", """
SELECT client, count(*) AS rows, CASE WHEN client = 'client5' THEN 0 ELSE count(quantity_sold) END AS usable_rows,
  CASE WHEN client = 'client4' THEN count(CASE WHEN quantity_sold > 0 THEN 1 END) ELSE 0 END AS negative_rows,
  CASE client WHEN 'client4' THEN 'NEGATIVE_QUANTITY' WHEN 'client5' THEN 'MISSING_COLUMNS:product_id' END AS reason
FROM sent GROUP BY 1""", "sent")


def write_feed(spark, sf, folder: str) -> None:
    """Orders as client files under `folder`, one subfolder per client."""
    orders = src.table(spark, sf, "orders")
    rows = orders.select(
        (F.col("o_custkey") % CLIENTS).alias("client"), F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")).alias("outlet_id"), F.concat("o_orderpriority", F.lit('"')).alias("product_id"),
        F.when(F.col("o_orderkey") % 50 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("quantity_sold"))
    text = rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))

    def of(df, client):
        return df.filter(F.col("client") == client).drop("client")

    def csv(df, name):
        df.write.option("header", True).option("escape", '"').option("quoteAll", name == "client1").csv(f"{folder}/{name}")

    csv(of(text, 0), "client0")
    csv(of(text, 1).select(F.col("quantity_sold").alias("Qty "), F.col("product_id").alias("SKU"), F.lit("a, b").alias("note"),
                           F.concat("date", F.lit(" 10:00:00")).alias("Sale_Date"), F.col("outlet_id").alias("STORE_ID")), "client1")
    of(text, 2).select(F.col("date").alias("timestamp"), F.col("outlet_id").alias("Outlet"), F.col("product_id").alias("item"),
                       F.col("quantity_sold").alias("units_sold")).write.json(f"{folder}/client2")
    of(rows, 3).select(F.col("quantity_sold").cast("int").alias("quantity"), "date", "outlet_id", "product_id").write.parquet(f"{folder}/client3")
    csv(of(text, 4).withColumn("quantity_sold", -F.col("quantity_sold")), "client4")
    csv(of(text, 5).drop("product_id"), "client5")
    of(rows, 6).select(F.col("date").cast("timestamp").alias("datetime"), F.col("outlet_id").alias("branch_id"), F.col("product_id").alias("sku"),
                       F.col("quantity_sold").cast("double").alias("quantity")).write.parquet(f"{folder}/client6")


def ingested(spark, sf) -> str:
    """The folder of the tables that an ingest of the feed leaves."""
    base = f"{shared_folder(spark)}/stockweave-ingest-{uuid4().hex}"
    write_feed(spark, sf, f"{base}/incoming")
    ingest.start_ingest(spark, f"{base}/incoming", f"{base}/tables", f"{base}/checkpoint").awaitTermination()
    return f"{base}/tables"


def client_of(path) -> F.Column:
    return F.regexp_extract(path, "/(client[0-9]+)/[^/]*$", 1).alias("client")


@query("ingest_manifest", "client rows:i usable_rows:i negative_rows:i reason status", """
SELECT *, CASE WHEN reason IS NULL THEN 'PROCESSED' ELSE 'REJECTED' END AS status FROM judged""", "judged")
def _(spark, sf):
    files = ingest.manifest_table(spark, ingested(spark, sf)).filter("rows > 0")
    return files.groupBy(client_of("source_file"), "reason", "status").agg(
        *[F.sum(c).alias(c) for c in ("rows", "usable_rows", "negative_rows")])


@query("ingest_quarantine", "client date outlet_id product_id quantity_sold reason copies:i", """
SELECT client, date, outlet_id, CASE WHEN client = 'client4' THEN product_id END AS product_id,
  CASE WHEN client = 'client4' THEN CAST(-quantity_sold AS VARCHAR) ELSE CAST(quantity_sold AS VARCHAR) END AS quantity_sold, reason, count(*) AS copies
FROM sent JOIN judged USING (client) WHERE reason IS NOT NULL GROUP BY ALL""", ("sent", "judged"))
def _(spark, sf):
    rows = ingest.quarantine_table(spark, ingested(spark, sf))
    return rows.groupBy(client_of("source_file"), "date", "outlet_id", "product_id", "quantity_sold", "reason").agg(F.count(F.lit(1)).alias("copies"))


SOLD = "SELECT outlet_id, product_id, CAST(date AS DATE) AS date, quantity_sold FROM sent JOIN judged USING (client) WHERE reason IS NULL AND quantity_sold IS NOT NULL"


@query("ingest_sales", "outlet_id product_id date:d quantity_sold:4",
       f"SELECT outlet_id, product_id, date, sum(quantity_sold) AS quantity_sold FROM ({SOLD}) a GROUP BY 1, 2, 3", ("sent", "judged"))
def _(spark, sf):
    return ingest.sales_table(spark, ingested(spark, sf))


@query("ingest_sufficiency", "rows:i days:i series:i reason sufficient:b", f"""
SELECT *, reason = 'SUFFICIENT_DATA' AS sufficient
FROM (SELECT count(*) AS rows, count(DISTINCT date) AS days, count(DISTINCT (outlet_id, product_id)) AS series,
  CASE WHEN count(*) < 1000 THEN 'INSUFFICIENT_DATA:' || count(*) || '<1000'
    WHEN count(DISTINCT date) < 88 THEN 'INSUFFICIENT_HISTORY:' || count(DISTINCT date) || '<88' ELSE 'SUFFICIENT_DATA' END AS reason
  FROM ({SOLD}) a) b""", ("sent", "judged"))
def _(spark, sf):
    """Over all committed batches; each batch has a row of its own as well."""
    return quality.sufficiency(ingest.sales_rows(spark, ingested(spark, sf)))
