"""Raw sources of the pipeline, derived from the given tables.

``oracle.py`` states the same definitions in SQL. Amounts are decimals, so both engines start from
the same numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def nothing() -> Column:
    return F.lit(None).cast("decimal(18,2)")


def times(amount: Column, factor: str) -> Column:
    return amount * F.lit(Decimal(factor))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    price = money("l_extendedprice")
    discount = F.col("l_discount").cast("decimal(4,2)")
    key = F.col("n_nationkey")
    # orders find their nation first, so the line items are shuffled by part and by order only
    placed = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.year("o_orderdate").alias("_year"), "n_nationkey", "n_name")
    )
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        placed, F.col("l_orderkey") == F.col("o_orderkey")
    )
    unrequired = (F.col("p_type") == "ECONOMY") & (key % 5 == 0)
    unfunded = (key % 7 == 0) & (F.col("p_type") == "PROMO")
    funded = (
        F.when(unfunded, None)
        .when(F.col("l_returnflag") == "R", -price)
        .when(F.col("l_returnflag") == "A", None)
        .otherwise(price * (F.lit(Decimal("1.00")) - discount))
    )
    return rows.select(
        F.col("n_name").alias("country_code"),
        F.col("p_size").cast("string").alias("sector_cluster_code"),
        F.col("p_type").alias("sector_cluster_name"),
        F.col("_year").alias("date_year"),
        F.concat(F.lit("Appeal "), "o_orderkey").alias("activity_appeal_name"),
        F.col("o_orderkey").cast("string").alias("activity_appeal_id_fts_internal"),
        F.when(unrequired, F.lit(Decimal("0.00")))
        .otherwise(price)
        .alias("value_funding_required_usd"),
        funded.alias("value_funding_total_usd"),
        times(discount, "100").alias("value_funding_pct"),
    )


def requirements_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a file would hold them: text, with gaps written out and bad cells."""
    raw = requirements(spark, sf_dir)
    appeal = F.col("activity_appeal_id_fts_internal").cast("long")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in raw.columns}
    text["date_year"] = F.concat(F.when(appeal % 11 == 0, "FY").otherwise(""), text["date_year"])
    code = text["sector_cluster_code"]
    odd = F.col("sector_cluster_code").cast("int") % 2 == 1
    text["sector_cluster_code"] = F.when(odd, F.concat(F.lit("C"), code)).otherwise(code)
    name = text["sector_cluster_name"]
    text["sector_cluster_name"] = F.concat(F.lit("  "), name, F.lit(" "))
    return raw.select(*[c.alias(n) for n, c in text.items()])


def elsewhere(condition: str) -> Column:
    """Nation names; where ``condition`` holds, one that no other table has, so joins miss it."""
    return F.expr(f"if({condition}, 'ELSEWHERE_' || n_nationkey, n_name)").alias("n_name")


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", elsewhere("n_nationkey in (3, 13)"))
    people = money("c_acctbal")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country_code"),
        F.col("c_mktsegment").alias("sector_description"),
        F.format_number(people, 2).alias("inneed"),
        F.format_number(times(people, "0.6"), 3).alias("targeted"),
        F.format_number(times(people, "10"), 1).alias("population"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", elsewhere("n_nationkey % 11 = 0"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("ISO3"),
        times(F.abs(money("s_acctbal")), "1000").cast("string").alias("Population"),
        (F.col("s_suppkey") % 5 + 2015).cast("string").alias("Reference_year"),
    )


def disasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    nation = F.when(F.expr("user_id % 25 = 8"), "ELSEWHERE_").otherwise("NATION_")
    return events.select(
        F.concat(nation, (F.col("user_id") % 25)).alias("ISO"),
        F.col("event_type").alias("Disaster_Type"),
        F.lit(None).cast("string").alias("Disaster_Subtype"),
        (F.col("event_id") % 10 + 2015).alias("Start_Year"),
        F.col("value").alias("Total_Deaths"),
        (F.col("value") * 1000).alias("Total_Affected"),
        F.when(F.col("event_type") != "error", F.col("value") * 10).alias("Total_Damage_000_US"),
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pledge = money("o_totalprice")
    status = F.col("o_orderstatus")
    paid = F.when(status == "F", pledge).when(status == "P", times(pledge, "0.5"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("PooledFundName"),
            F.col("n_nationkey").alias("PooledFundId"),
            F.year("o_orderdate").alias("FiscalYear"),
            F.col("c_mktsegment").alias("DonorName"),
            F.lit(None).cast("string").alias("CountryCode"),
            pledge.alias("PledgeAmt"),
            paid.alias("PaidAmt"),
        )
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = supplier.agg(F.count(F.lit(1))).scalar()
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("_org", key % suppliers)
    located = key % 10 != 0
    return (
        part.join(supplier, F.col("_org") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("PooledFundName"),
            key.cast("string").alias("ChfProjectCode"),
            F.col("s_name").alias("OrganizationName"),
            F.col("p_brand").alias("OrganizationType"),
            F.col("p_name").alias("ProjectTitle"),
            (key % 10 + 1992).cast("string").alias("AllocationYear"),
            F.when(F.col("p_size") > 25, "Standard").otherwise("Reserve").alias("AllocationType"),
            money("p_retailprice").cast("string").alias("Budget"),
            F.lit("Closed").alias("ProjectStatus"),
            F.col("p_type").alias("Cluster"),
            F.col("p_size").cast("string").alias("ClusterPercentage"),
            F.concat(F.lit("ADM"), key % 7).alias("AdminLocation1"),
            F.when(located, key * 37 % 18000 / 100 - 90).alias("AdminLocation1Latitude"),
            F.when(located, key * 91 % 36000 / 100 - 180).alias("AdminLocation1Longitude"),
            F.lit("2a").alias("GenderMarker"),
            F.lit("A").alias("EnvironmentMarker"),
            F.lit("01/02/2020").alias("ActualStartDate"),
            F.lit("31/12/2020").alias("ActualEndDate"),
        )
    )


def feature_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw sources of the feature table."""
    return {
        "fts_requirements": requirements(spark, sf_dir),
        "hno": needs(spark, sf_dir),
        "population": population(spark, sf_dir),
        "emdat": disasters(spark, sf_dir),
    }


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return feature_sources(spark, sf_dir) | {
        "contributions": contributions(spark, sf_dir),
        "projects": projects(spark, sf_dir),
    }


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text, with columns on both sides of the share at which text turns to numbers."""
    key = F.col("o_orderkey")
    customer = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("order_id"),
        F.format_number(money("o_totalprice"), 2).alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.when(key % 10 == 0, "unknown").otherwise(customer).alias("mostly_numbers"),
        F.when(key % 2 == 0, "unknown").otherwise(customer).alias("half_numbers"),
        customer.alias("country_code"),
    )
