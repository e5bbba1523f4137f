"""The registered queries: every operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from uuid import uuid4

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import proxies, trees
from fairshare.functions import display
from fairshare.functions.labels import SECTOR_MAP, with_canonical_label
from fairshare.operators import (
    aggregates,
    allocate,
    clean,
    features,
    filters,
    forest,
    peers,
    quality,
    quantile,
    runs,
    sampling,
    scaling,
    serving,
)
from fairshare.plans import prep, tables
from fairshare.sources.coerce import safe_coerce
from fairshare.sources.ingest import Dataset, ingest, summarize
from fairshare.sources.statistics import file_statistics
from fairshare.sources.names import punctuated_name
from fairshare.sources.tables import read_tables, register_views, settle, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

BUDGET_SHARE = 0.4
REFIT_STEPS = 5
UNKNOWN_LABELS = ["no such sector", "", "wash-total"]
CANONICAL = {
    "automobile": "logistics",
    "building": "shelter and nfi",
    "household": "wash",
    "machinery": "logistics",
}
BASE_VALUES = ["total_requirements_usd", "total_funding_usd", "funding_pct"]
CONTEXT_VALUES = [
    "total_inneed", "total_targeted", "hno_population", "total_population",
    "total_disaster_deaths_5yr", "total_disaster_affected_5yr",
    "total_disaster_damage_000usd_5yr",
]
SECTOR_VALUES = ["sector_total_funding_usd", "sector_total_requirements_usd"]

_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A pipeline table that later queries read, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = settle(build(), name)
    return _stored[key]


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return tables.features_table(proxies.feature_sources(spark, sf_dir))

    return stored(spark, sf_dir, "features", build)


def contribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return tables.contributions_table({"contributions": proxies.contributions(spark, sf_dir)})

    return stored(spark, sf_dir, "contributions", build)


def project_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return tables.projects_table({"projects": proxies.projects(spark, sf_dir)})

    return stored(spark, sf_dir, "projects", build)


def anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir)
    return stored(spark, sf_dir, "anomalies", lambda: tables.detect(rows))


def costly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-ready rows flagged by what they cost per person: a score SQL can state too."""
    ready = scaling.ml_ready(feature_rows(spark, sf_dir))
    return forest.flag_by_contamination(ready, "cost_per_beneficiary")


def rounded(df: DataFrame, columns: Iterable[str], digits: int) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; compare without those."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def selection(spark: SparkSession, sf_dir: str, **changes) -> filters.Selection:
    picked = filters.default_selection(feature_rows(spark, sf_dir))
    return filters.Selection(**{**picked.__dict__, **changes})


def filtered(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    picked = selection(spark, sf_dir, **changes)
    return filters.apply_selection(feature_rows(spark, sf_dir), picked)


# sources and cleaning


def coerce_orders(spark, sf_dir):
    """Cells that are no number turn null; shown as -1."""
    coerced = safe_coerce(proxies.orders_text(spark, sf_dir))
    return coerced.withColumn("mostly_numbers", F.coalesce("mostly_numbers", F.lit(-1)))


def coerce_long_codes(spark, sf_dir):
    """Codes of 19 digits, which a double cannot hold."""
    lines = proxies.table(spark, sf_dir, "lineitem")
    code = F.lit(10**18) + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = lines.select(code.cast("string").alias("code"), F.col("l_quantity").cast("string").alias("quantity"))
    return safe_coerce(text).withColumn("quantity", F.col("quantity").cast("double"))


def ingested_orders(spark, sf_dir):
    """Orders written as CSV, with quotes, line breaks and gaps, and taken in again."""
    order = F.col("o_orderkey")
    note = F.concat(F.lit('a "quoted", part\n'), F.col("o_custkey"))
    cells = proxies.table(spark, sf_dir, "orders").select(
        order.cast("string").alias("Order ID"),
        F.col("o_orderstatus").alias("Status"),
        F.format_number(proxies.money("o_totalprice"), 2).alias("Price"),
        F.when(order % 5 != 0, note).alias("Note"),
    )
    name = f"given_{uuid4().hex[:8]}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    cells.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    status = ingest(spark, {"orders": Dataset(path, constants={"origin": "given"})}, name).first()
    if status["error"]:
        raise RuntimeError(status["error"])
    found, _ = read_tables(spark, ["raw_orders"], name)
    return found["raw_orders"]


def ingested_tagged(spark, sf_dir):
    """Customers as tagged files and suppliers under punctuated labels, taken in and joined through views.

    Tags and labels repeat once cleaned, so names get suffixes; each file has its tag line.
    """
    customer = proxies.table(spark, sf_dir, "customer")
    cells = customer.select(
        F.col("c_custkey").cast("string").alias("Number"),
        F.col("c_name").alias("Name"),
        F.concat(F.lit("#"), "c_mktsegment").alias("Segment, as told"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("Nation"),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("Balance"),
    )

    tags = dict(zip(cells.columns, ["#cust+id", "#org+name", "#org+name", "#adm1+code", "#value +usd"]))

    def tagged(batches):
        yield pd.DataFrame([tags])
        yield from batches

    supplier = proxies.table(spark, sf_dir, "supplier")
    labelled = supplier.select(
        F.col("s_suppkey").cast("string").alias("Supplier No."),
        F.lpad(F.col("s_nationkey").cast("string"), 3, "0").alias("Nation/Adm1 ('code')"),
        F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("Balance ($)"),
        F.col("s_name").alias("Balance $"),
    )
    name = f"given_{uuid4().hex[:8]}"
    paths = [f"{shared_dir(spark).rstrip('/')}/{name}-{part}" for part in ("tagged", "plain")]
    cells.mapInPandas(tagged, cells.schema).write.csv(paths[0], header=True)
    labelled.write.csv(paths[1], header=True, escape='"')
    given = {"tagged": Dataset(paths[0], hxl=True), "plain": Dataset(paths[1], clean=punctuated_name)}
    for row in ingest(spark, given, name).collect():
        if row["error"]:
            raise RuntimeError(row["error"])
    found, _ = read_tables(spark, ["raw_tagged", "raw_plain"], name)
    register_views({f"{name}_{k}": df for k, df in found.items()})
    return spark.sql(f"""
        select c.cust_id, c.org_name, c.org_name_1, c.adm1_code, c.value__usd, s.suppliers, s.balance, s.first_name
        from {name}_raw_tagged c left join (
          select Nation_Adm1_code, count(Supplier_No) suppliers, round(sum(Balance_), 2) + 0.0 balance, min(Balance__1) first_name
          from {name}_raw_plain group by 1) s on s.Nation_Adm1_code = cast(c.adm1_code as bigint)""")


def flag_with_gaps(spark, sf_dir):
    """Half of the prices flagged, among nulls, NaN and infinity."""
    kind = F.col("l_orderkey") % 7
    odd = F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(float("inf")))
    x = F.when(kind > 2, F.col("l_extendedprice").cast("double")).when(kind > 0, odd)
    lines = proxies.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return forest.flag_by_contamination(lines, "x", 0.5).select("l_orderkey", "l_linenumber", "is_anomaly")


def dataset_summary(spark, sf_dir):
    frames = {name: proxies.table(spark, sf_dir, name) for name in proxies.NAMES}
    return summarize(frames)


def table_statistics(spark, sf_dir):
    return file_statistics(spark, {name: f"{sf_dir}/{name}.parquet" for name in proxies.NAMES})


def prep_requirements(spark, sf_dir):
    return prep.prep_requirements(proxies.requirements_text(spark, sf_dir))


def prep_needs(spark, sf_dir):
    return prep.prep_needs(proxies.needs(spark, sf_dir))


def prep_population(spark, sf_dir):
    return prep.prep_population(proxies.population(spark, sf_dir))


def prep_projects(spark, sf_dir):
    return prep.prep_projects(proxies.projects(spark, sf_dir))


def prep_contributions(spark, sf_dir):
    return prep.prep_contributions(proxies.contributions(spark, sf_dir))


def prep_disasters(spark, sf_dir):
    return prep.prep_disasters(proxies.disasters(spark, sf_dir))


def canonical_labels(spark, sf_dir):
    needs = proxies.needs(spark, sf_dir)
    named = with_canonical_label(needs, "sector_description", "sector", CANONICAL)
    return named.groupBy("country_code", "sector_description", "sector").agg(
        F.count(F.lit(1)).alias("rows")
    )


def sector_labels(spark, sf_dir):
    """Orders labelled in turn with every known label, spelled three ways, and a few unknown ones."""
    raw = F.array(*[F.lit(x) for x in [*SECTOR_MAP, *UNKNOWN_LABELS]])
    number = F.col("o_orderkey") % (len(SECTOR_MAP) + len(UNKNOWN_LABELS))
    label = F.get(raw, number.cast("int"))
    spelled = F.when(F.col("o_custkey") % 3 == 0, F.upper(label))
    spelled = spelled.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("  "), label, F.lit(" "))).otherwise(label)
    rows = proxies.table(spark, sf_dir, "orders").select(spelled.alias("label"))
    named = with_canonical_label(rows, "label", "sector").groupBy("label", "sector")
    return named.agg(F.count(F.lit(1)).alias("rows"))


def cleaned_requirements(spark, sf_dir):
    prepped = prep.prep_requirements(proxies.requirements(spark, sf_dir))
    return aggregates.clean_requirements(prepped).select(
        "appeal_id", "cluster_name", "year", "total_requirements_usd", "total_funding_usd"
    )


# aggregates and features


def merged(spark, sf_dir):
    prepped = prep.prep_requirements(proxies.requirements(spark, sf_dir))
    return aggregates.merge_appeals(aggregates.clean_requirements(prepped))


def merged_requirements(spark, sf_dir):
    return rounded(merged(spark, sf_dir), BASE_VALUES, 4)


def unbacked_rows(spark, sf_dir):
    return clean.count_unbacked(merged(spark, sf_dir))


def base_requirements(spark, sf_dir):
    return rounded(clean.drop_unbacked(merged(spark, sf_dir)), BASE_VALUES, 4)


def needs_by_country(spark, sf_dir):
    by = aggregates.needs_by(prep.prep_needs(proxies.needs(spark, sf_dir)))
    return rounded(by, CONTEXT_VALUES[:3], 3)


def needs_by_sector(spark, sf_dir):
    """Needs at country and canonical sector instead of country alone."""
    prepped = prep.prep_needs(proxies.needs(spark, sf_dir))
    named = with_canonical_label(prepped, "sector_description", "sector", CANONICAL)
    by = aggregates.needs_by(named, ["country_code", "sector"])
    return rounded(by, CONTEXT_VALUES[:3], 3)


def population_by_country(spark, sf_dir):
    prepped = prep.prep_population(proxies.population(spark, sf_dir))
    return rounded(aggregates.population_by(prepped), ["total_population"], 2)


def latest_population(spark, sf_dir):
    prepped = prep.prep_population(proxies.population(spark, sf_dir))
    by = aggregates.population_by(prepped, latest_only=True)
    return rounded(by, ["total_population"], 2)


def contributions_by_fund_year(spark, sf_dir):
    prepped = prep.prep_contributions(proxies.contributions(spark, sf_dir))
    by = aggregates.contributions_by_fund_year(prepped)
    return rounded(by, ["total_pledged_usd", "total_paid_usd"], 3)


def donors_merged(spark, sf_dir):
    """Donors by fund, by year and at all: counted, and estimated from stored sketches of fund and year."""
    orders = proxies.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    customer = proxies.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = proxies.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country_name"))
    funds = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    donor = F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("donor "), "o_custkey"))
    gifts = orders.join(funds, F.col("o_custkey") == F.col("c_custkey")).select(
        "country_name", "year", donor.alias("donor_name")
    )
    sketches = settle(aggregates.donor_sketches(gifts), "donors")
    most = F.lit(4 * aggregates.donor_error())
    out = None
    for level, keys in {"fund": ["country_name"], "year": ["year"], "all": []}.items():
        about = aggregates.donors_by(sketches, keys).withColumnRenamed("num_donors", "about")
        exact = gifts.groupBy(*keys).agg(F.count_distinct("donor_name").alias("num_donors"))
        name = F.col(keys[0]).cast("string") if keys else F.lit("")
        part = exact.join(about, keys) if keys else exact.withColumn("about", about.scalar())
        near = F.abs(F.col("about") - F.col("num_donors")) <= F.greatest(F.lit(1.0), most * F.col("num_donors"))
        part = part.select(F.lit(level).alias("level"), name.alias("name"), "num_donors", near.alias("near"))
        out = part if out is None else out.unionByName(part)
    return out


def disasters_by_country(spark, sf_dir):
    prepped = prep.prep_disasters(proxies.disasters(spark, sf_dir))
    return rounded(aggregates.disasters_by_country(prepped), CONTEXT_VALUES[4:], 3)


def joined_context(spark, sf_dir):
    joined = features.join_context(
        clean.drop_unbacked(merged(spark, sf_dir)),
        aggregates.needs_by(prep.prep_needs(proxies.needs(spark, sf_dir))),
        aggregates.population_by(prep.prep_population(proxies.population(spark, sf_dir))),
        aggregates.disasters_by_country(prep.prep_disasters(proxies.disasters(spark, sf_dir))),
    )
    return rounded(rounded(joined, BASE_VALUES, 4), CONTEXT_VALUES, 3)


def sector_totals(spark, sf_dir):
    base = clean.drop_unbacked(merged(spark, sf_dir))
    totals = features.with_sector_totals(base).select(*features.KEY, *SECTOR_VALUES)
    return rounded(totals, SECTOR_VALUES, 4)


def feature_table(spark, sf_dir):
    """The whole feature build, from the given tables to the last ratio."""
    built = tables.features_table(proxies.feature_sources(spark, sf_dir))
    kept = built.select(*features.KEY, "num_appeals", "num_disasters_5yr", *features.RATIOS)
    return rounded(kept, features.RATIOS, 5)


# quality


def null_profile(spark, sf_dir):
    return rounded(quality.null_profile(feature_rows(spark, sf_dir)), ["null_pct"], 6)


def range_check(spark, sf_dir):
    found = quality.range_check(feature_rows(spark, sf_dir))
    return rounded(found, ["min_val", "max_val", "avg_val", "std_val"], 2)


def zero_check(spark, sf_dir):
    return rounded(quality.zero_check(feature_rows(spark, sf_dir)), ["zero_pct"], 6)


def join_coverage(spark, sf_dir):
    return rounded(quality.join_coverage(feature_rows(spark, sf_dir)), ["match_pct"], 6)


def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(feature_rows(spark, sf_dir))


def _cleaned(spark, sf_dir):
    prepped = prep.prep_requirements(proxies.requirements(spark, sf_dir))
    return aggregates.clean_requirements(prepped)


def duplicate_keys_unmerged(spark, sf_dir):
    return quality.duplicate_keys(_cleaned(spark, sf_dir))


def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(_cleaned(spark, sf_dir))


def issues(spark, sf_dir):
    return rounded(quality.issues(feature_rows(spark, sf_dir)), ["value"], 4)


def issues_unmerged(spark, sf_dir):
    """The same checks on the rows before they are merged: keys repeat, features are absent."""
    return rounded(quality.issues(_cleaned(spark, sf_dir)), ["value"], 4)


def issues_broken(spark, sf_dir):
    """The checks on rows that break every rule: twice each, mostly null, and beyond both bounds elsewhere."""
    rows = feature_rows(spark, sf_dir)
    told, even = F.col("year") % 4 == 1, F.col("num_appeals") % 2 == 0
    broken = {"cluster_name": F.lit(None).cast("string")}
    for c in ["country_code", "year"]:
        broken[c] = F.when(told, F.col(c))
    for c in {*quality.NULL_COLUMNS, *quality.BOUNDS} - set(features.KEY):
        low, high = quality.BOUNDS.get(c, (0, None))
        beyond = F.lit(low - 1.0) if high is None else F.when(even, low - 1.0).otherwise(high + 1.0)
        broken[c] = F.when(told, beyond)
    rows = rows.withColumns(broken)
    return rounded(quality.issues(rows.unionByName(rows)), ["value"], 4)


def sample_rows(spark, sf_dir):
    sample = quality.sample_rows(feature_rows(spark, sf_dir))
    return rounded(sample, quality.SAMPLE_COLUMNS[3:], 4)


# filters and serving


def filter_countries(spark, sf_dir):
    return filters.filter_values(feature_rows(spark, sf_dir), "country_code")


def filter_clusters(spark, sf_dir):
    return filters.filter_values(feature_rows(spark, sf_dir), "cluster_name")


def filter_years(spark, sf_dir):
    return filters.filter_values(feature_rows(spark, sf_dir), "year", descending=True)


def default_selection(spark, sf_dir):
    """The rows of the default selection by what was picked."""
    rows = filtered(spark, sf_dir)
    return rows.groupBy("country_code", "cluster_name", "year").agg(
        F.count(F.lit(1)).alias("rows")
    )


def filtered_features(spark, sf_dir):
    rows = filtered(spark, sf_dir).select(*features.KEY, "funding_gap_pct")
    return rounded(rows, ["funding_gap_pct"], 5)


def filtered_wide_gaps(spark, sf_dir):
    rows = filtered(spark, sf_dir, min_gap=50).select(*features.KEY, "funding_gap_pct")
    return rounded(rows, ["funding_gap_pct"], 5)


def filtered_projects(spark, sf_dir):
    picked = selection(spark, sf_dir)
    columns = {"countries": "country_name", "years": "year"}
    rows = filters.apply_selection(project_rows(spark, sf_dir), picked, columns)
    return rows.select("project_code", "country_name", "year", "cluster", "budget")


def filtered_anomalies(spark, sf_dir):
    picked = selection(spark, sf_dir, anomalies_only=True, years=[])
    rows = filters.apply_selection(costly_rows(spark, sf_dir), picked)
    return rows.select(*features.KEY, "is_anomaly")


def kpis(spark, sf_dir):
    row = serving.kpis(feature_rows(spark, sf_dir), costly_rows(spark, sf_dir))
    sums = ["total_requirements_usd", "total_funding_usd", "total_gap_usd", "total_inneed"]
    return rounded(rounded(row, sums, 4), ["avg_coverage_pct"], 6)


def kpis_filtered(spark, sf_dir):
    picked = selection(spark, sf_dir)
    rows = filters.apply_selection(feature_rows(spark, sf_dir), picked)
    flags = filters.apply_selection(costly_rows(spark, sf_dir), picked)
    units = serving.kpi_units(serving.kpis(rows, flags))
    return rounded(units, [c for c in units.columns if c != "anomalies_flagged"], 6)


def gap_by_country(spark, sf_dir):
    by = serving.gap_by_country(feature_rows(spark, sf_dir))
    return rounded(rounded(by, ["requirements", "funding"], 4), ["gap_pct"], 6)


def coverage_by_cluster(spark, sf_dir):
    by = serving.coverage_by_cluster(feature_rows(spark, sf_dir))
    return rounded(rounded(by, ["requirements", "funding"], 4), ["coverage"], 6)


def yearly_trend(spark, sf_dir):
    by = serving.yearly_trend(feature_rows(spark, sf_dir))
    return rounded(rounded(by, ["requirements", "funding"], 4), by.columns[3:], 8)


def metric_map(spark, sf_dir):
    """Every map metric per country; ties of the rounding all go up."""
    means = serving.metric_map(feature_rows(spark, sf_dir), serving.MAP_METRICS)
    lifted = means.withColumn("value", F.col("value") * (1 + 1e-12))
    return rounded(lifted.withColumn("label", display.prettify(F.col("metric"))), ["value"], 4)


def project_points(spark, sf_dir):
    return serving.project_points(project_rows(spark, sf_dir))


def country_bubbles(spark, sf_dir):
    by = serving.country_bubbles(feature_rows(spark, sf_dir))
    return rounded(by, ["requirements", "funding", "inneed"], 4)


def bubble_diagonal(spark, sf_dir):
    by = serving.country_bubbles(feature_rows(spark, sf_dir))
    return rounded(serving.bubble_diagonal(by), ["max_val"], 4)


def coverage_heatmap(spark, sf_dir):
    grid = serving.coverage_heatmap(feature_rows(spark, sf_dir))
    return rounded(grid, [c for c in grid.columns if c != "country_code"], 6)


def contributions_filtered(spark, sf_dir):
    years = selection(spark, sf_dir).years
    rows = filters.where_in(contribution_rows(spark, sf_dir), "year", years)
    return rounded(rows, ["total_pledged_usd", "total_paid_usd"], 3)


def top_funds(spark, sf_dir):
    years = selection(spark, sf_dir).years
    by = serving.top_funds(contribution_rows(spark, sf_dir), years)
    return rounded(by, ["total_paid_usd"], 3)


def pledged_vs_paid(spark, sf_dir):
    by = serving.pledged_vs_paid(contribution_rows(spark, sf_dir))
    return rounded(by, ["pledged_mn", "paid_mn"], 6)


# allocation


def _budget(rows):
    return allocate.share_of_requirements(rows, BUDGET_SHARE)


def _allocated(spark, sf_dir, objective):
    rows = feature_rows(spark, sf_dir)
    return allocate.allocate(rows, _budget(rows), objective)


def _rounded_allocation(df):
    amounts = ["requirements", "targeted", "allocated_usd", "expected_beneficiaries"]
    return rounded(rounded(df, amounts, 4), ["impact_per_dollar", "allocation"], 6)


def allocate_impact(spark, sf_dir):
    return _rounded_allocation(_allocated(spark, sf_dir, "impact"))


def allocate_beneficiaries(spark, sf_dir):
    return _rounded_allocation(_allocated(spark, sf_dir, "beneficiaries"))


def allocate_default_budget(spark, sf_dir):
    return _rounded_allocation(allocate.allocate(feature_rows(spark, sf_dir)))


def allocation_totals(spark, sf_dir):
    totals = allocate.allocation_totals(_allocated(spark, sf_dir, "impact"))
    amounts = ["total_beneficiaries", "total_allocated"]
    return rounded(rounded(totals, amounts, 4), ["impact_per_dollar"], 6)


def top_allocations(spark, sf_dir):
    return _rounded_allocation(allocate.top_allocations(_allocated(spark, sf_dir, "impact")))


def funded_lines(spark, sf_dir):
    return _rounded_allocation(allocate.funded_lines(_allocated(spark, sf_dir, "impact")))


def allocation_report(spark, sf_dir):
    return display.allocation_report(_rounded_allocation(_allocated(spark, sf_dir, "impact")))


def available_funding(spark, sf_dir):
    found = allocate.available_funding(feature_rows(spark, sf_dir))
    return rounded(found, ["budget_usd"], 4)


# models


def ml_ready(spark, sf_dir):
    ready = scaling.ml_ready(feature_rows(spark, sf_dir))
    return rounded(ready, ready.columns[3:], 4)


def scaler_moments(spark, sf_dir):
    found = scaling.moments(scaling.ml_ready(feature_rows(spark, sf_dir)))
    return rounded(found, ["mean", "deviation"], 5)


def _scaled(spark, sf_dir):
    ready = scaling.ml_ready(feature_rows(spark, sf_dir))
    return scaling.fit_scaler(ready).transform(ready)


def scaled_features(spark, sf_dir):
    scaled = _scaled(spark, sf_dir).select(*features.KEY, *scaling.ML_FEATURES)
    return rounded(scaled, scaling.ML_FEATURES, 6)


def flag_by_contamination(spark, sf_dir):
    """Line items priced above the exact 95 % quantile."""
    lines = proxies.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    flagged = forest.flag_by_contamination(lines, "l_extendedprice")
    return rounded(flagged, ["anomaly_score"], 4)


def flag_by_sketches(spark, sf_dir):
    """Line items above the exact 95 % quantile, found from stored sketches by return flag and month."""
    lines = proxies.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.month("l_shipdate").alias("month")
    )
    made = quantile.value_sketches(lines, "l_extendedprice", ["l_returnflag", "month"])
    rows = lines.drop("l_returnflag", "month")
    flagged = forest.flag_by_contamination(rows, "l_extendedprice", sketches=settle(made, "sketches"))
    return rounded(flagged, ["anomaly_score"], 4)


def stored_forest_flags(spark, sf_dir):
    """Line items scored and flagged by a forest that was stored and read again; gaps go left."""
    lines = proxies.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("double")).alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_discount").cast("double")).alias("discount"),
    )
    grown = [(i, *trees.arrays(tree)) for i, tree in enumerate(trees.TREES)]
    frame = spark.createDataFrame(grown, forest.TREE_SCHEMA)
    stored = forest.StoredForest(frame, 1000, trees.SAMPLE, trees.FLAG_ABOVE)
    again = runs.forest_from(settle(runs.forest_frame(stored), "forest"))
    flagged = forest.apply_forest(lines, again, trees.FEATURES, in_engine=True)
    kept = flagged.select("l_orderkey", "l_linenumber", "raw_score", "anomaly_score", "is_anomaly")
    return rounded(kept, ["raw_score", "anomaly_score"], 9)


def top_costly(spark, sf_dir):
    top = serving.top_anomalies(costly_rows(spark, sf_dir))
    return rounded(top, top.columns[3:], 4)


def worst_costly(spark, sf_dir):
    worst = serving.worst_anomaly(costly_rows(spark, sf_dir))
    return rounded(worst.select(*features.KEY, "anomaly_score"), ["anomaly_score"], 4)


def costly_by_sector(spark, sf_dir):
    return serving.anomalies_by_sector(costly_rows(spark, sf_dir))


def costly_summary(spark, sf_dir):
    return rounded(serving.anomaly_summary(costly_rows(spark, sf_dir)), ["anomaly_rate"], 8)


def costly_score_vs_gap(spark, sf_dir):
    points = serving.score_vs_gap(costly_rows(spark, sf_dir))
    return rounded(points, ["funding_gap_pct", "anomaly_score"], 4)


def costly_radar(spark, sf_dir):
    return rounded(serving.radar(costly_rows(spark, sf_dir)), ["value"], 6)


def few(df: DataFrame, most: int = 1000) -> list:
    """The rows of a frame that must be small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centres")
    return rows


def _label_means(spark, sf_dir):
    """One mean vector per label."""
    vectors = proxies.table(spark, sf_dir, "embeddings")
    means = vectors.groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("center")
    )
    return [r["center"] for r in few(means.orderBy("label"))]


def _near_labels(spark, sf_dir):
    vectors = proxies.table(spark, sf_dir, "embeddings")
    centers = _label_means(spark, sf_dir)
    return peers.nearest_center(vectors, "embedding", centers, "cluster_id", "distance")


def nearest_center(spark, sf_dir):
    near = _near_labels(spark, sf_dir).select("vec_id", "cluster_id", "distance")
    return rounded(near, ["distance"], 6)


def nearest_center_with_gaps(spark, sf_dir):
    """As ``nearest_center``, with every third vector null."""
    gap = F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))
    vectors = proxies.table(spark, sf_dir, "embeddings").withColumn("embedding", gap)
    found = peers.nearest_center(vectors, "embedding", _label_means(spark, sf_dir))
    return found.select("vec_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def nearest_inertia(spark, sf_dir):
    return rounded(peers.inertia(_near_labels(spark, sf_dir), "distance"), ["inertia"], 4)


def nearest_group_sizes(spark, sf_dir):
    return peers.group_sizes(_near_labels(spark, sf_dir), "cluster_id", "label")


def label_silhouette(spark, sf_dir):
    vectors = proxies.table(spark, sf_dir, "embeddings")
    return rounded(peers.silhouette_of_all(vectors, "embedding", ["label"]), ["silhouette"], 6)


def label_silhouette_sample(spark, sf_dir):
    """By Euclidean distance, over the rows with the least key digests; its SQL draws the same rows."""
    vectors = proxies.table(spark, sf_dir, "embeddings")
    found = peers.silhouette(vectors, "embedding", ["label"], ["vec_id"])
    return rounded(found, ["silhouette"], 6)


def peer_benchmark(spark, sf_dir):
    """Rows against their peers; a peer group gathers around the mean of a sector."""
    scaled = _scaled(spark, sf_dir)
    means = scaled.groupBy("cluster_name").agg(*[F.avg(c).alias(c) for c in scaling.ML_FEATURES])
    centers = [r[1:] for r in few(means.orderBy("cluster_name"))]
    # labelled once: the means and the rows both read what is stored
    grouped = settle(peers.nearest_center(scaled, scaling.ML_FEATURES, centers), "labelled")
    gaps = [f"{c}_vs_peers" for c in scaling.ML_FEATURES]
    against = peers.peer_benchmark(grouped).select(*features.KEY, "cluster_id", *gaps)
    return rounded(against, gaps, 5)


def _refit(spark, sf_dir):
    """Rows flagged by cost with scaled features, and groups that start at the means of the sectors."""
    flagged = costly_rows(spark, sf_dir)
    scaled = scaling.fit_scaler(flagged).transform(flagged, "scaled_")
    names = [f"scaled_{c}" for c in scaling.ML_FEATURES]
    scaled = settle(scaled, "scaled")
    means = scaled.groupBy("cluster_name").agg(*[F.avg(c).alias(c) for c in names])
    centers = [r[1:] for r in few(means.orderBy("cluster_name"))]
    return scaled, peers.refit_peers(scaled, centers, names, max_steps=REFIT_STEPS, tolerance=0.0)


def refit_centers(spark, sf_dir):
    """Centres of the groups after the steps from the sectors' means."""
    _, model = _refit(spark, sf_dir)
    rows = [(i, *map(float, center)) for i, center in enumerate(model.centers)]
    schema = "cluster_id int, " + ", ".join(f"{c} double" for c in scaling.ML_FEATURES)
    return rounded(spark.createDataFrame(rows, schema), scaling.ML_FEATURES, 6)


def refit_groups(spark, sf_dir):
    scaled, model = _refit(spark, sf_dir)
    return peers.label_rows(scaled, model).select(*features.KEY, "cluster_id")


def top_costly_grouped(spark, sf_dir):
    """The flagged rows of the highest score with the group that each is in."""
    scaled, model = _refit(spark, sf_dir)
    top = serving.top_anomalies(peers.label_rows(scaled, model))
    values = ["total_requirements_usd", "total_funding_usd", "funding_gap_pct", "anomaly_score"]
    return rounded(top, values, 4)


def costly_by_group(spark, sf_dir):
    """Rows by group and flag."""
    scaled, model = _refit(spark, sf_dir)
    return peers.group_sizes(peers.label_rows(scaled, model), "cluster_id", "is_anomaly")


def isolation_forest(spark, sf_dir):
    """The fitted trees by size: one row per tree."""
    ready = scaling.ml_ready(feature_rows(spark, sf_dir))
    trees = forest.fit_forest(ready, ready.count())
    leaves = F.size(F.filter("feature", lambda f: f < 0))
    return trees.select("tree", F.size("feature").alias("nodes"), leaves.alias("leaves"))


def forest_draws(spark, sf_dir):
    """How often each row is drawn for a tree, and the sum of its ranks there."""
    ready = scaling.ml_ready(feature_rows(spark, sf_dir))
    drawn = forest.draw_rows(ready).groupBy("_digest")
    drawn = drawn.agg(F.count(F.lit(1)).alias("trees"), F.sum("n").alias("ranks"))
    named = ready.select(*features.KEY, sampling.key_digest(features.KEY, forest.SEED).alias("_digest"))
    return named.join(drawn, "_digest").drop("_digest")


def forest_trees(spark, sf_dir):
    """Per tree whether inner nodes are one less than leaves, and the rows that it was grown on."""
    ready = settle(scaling.ml_ready(feature_rows(spark, sf_dir)), "ready")
    trees = forest.fit_forest(ready, ready.count())
    leaves = F.size(F.filter("feature", lambda f: f < 0))
    whole = (F.size("feature") == leaves * 2 - 1).cast("int").alias("binary")
    drawn = forest.draw_rows(ready).groupBy("tree").agg(F.count(F.lit(1)).alias("sample"))
    return trees.select("tree", whole).join(drawn, "tree")


def anomalies(spark, sf_dir):
    return anomaly_rows(spark, sf_dir)


def top_anomalies(spark, sf_dir):
    return serving.top_anomalies(anomaly_rows(spark, sf_dir))


def top_anomalies_report(spark, sf_dir):
    return display.anomaly_report(serving.top_anomalies(anomaly_rows(spark, sf_dir)))


def worst_anomaly(spark, sf_dir):
    return serving.worst_anomaly(anomaly_rows(spark, sf_dir))


def anomaly_summary(spark, sf_dir):
    return serving.anomaly_summary(anomaly_rows(spark, sf_dir))


def anomalies_by_sector(spark, sf_dir):
    return serving.anomalies_by_sector(anomaly_rows(spark, sf_dir))


def score_vs_gap(spark, sf_dir):
    return serving.score_vs_gap(anomaly_rows(spark, sf_dir))


def radar(spark, sf_dir):
    return serving.radar(anomaly_rows(spark, sf_dir))


def _peer_fit(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fits:
        scaled = _scaled(spark, sf_dir)
        rows = scaled.count()
        fitted = peers.fit_peers(scaled, rows)
        _fits[key] = scaled, fitted, peers.sweep(scaled, rows, fitted)
    return _fits[key]


_fits: dict[tuple[str, str], tuple] = {}


def grouped_rows(spark, sf_dir):
    """The anomalies table as it is published: scores, flags and groups."""
    rows = feature_rows(spark, sf_dir)
    return stored(spark, sf_dir, "grouped", lambda: tables.model(rows).anomalies)


def grouped_anomalies(spark, sf_dir):
    return grouped_rows(spark, sf_dir)


def top_grouped_anomalies(spark, sf_dir):
    """The table of flagged allocations, with groups."""
    return serving.top_anomalies(grouped_rows(spark, sf_dir))


def anomalies_by_group(spark, sf_dir):
    """Rows by group and flag."""
    return peers.group_sizes(grouped_rows(spark, sf_dir), "cluster_id", "is_anomaly")


def peer_sweep(spark, sf_dir):
    """Inertia and silhouette of the best fit for every k, and which k is taken."""
    _, _, found = _peer_fit(spark, sf_dir)
    best = peers.best_k(found)
    rows = [(k, i, s, k == best) for k, i, s in found]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, chosen boolean")


def peer_groups(spark, sf_dir):
    scaled, fitted, found = _peer_fit(spark, sf_dir)
    labelled = peers.label_rows(scaled, fitted[peers.best_k(found)])
    return labelled.select(*features.KEY, "cluster_id")


def peer_group_sizes(spark, sf_dir):
    return peers.group_sizes(peer_groups(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        coerce_orders, coerce_long_codes, ingested_orders, ingested_tagged, dataset_summary, table_statistics,
        flag_with_gaps, nearest_center_with_gaps,
        prep_requirements, prep_needs, prep_population,
        prep_projects, prep_contributions, prep_disasters,
        canonical_labels, sector_labels, cleaned_requirements,
        merged_requirements, unbacked_rows, base_requirements,
        needs_by_country, needs_by_sector, population_by_country, latest_population,
        contributions_by_fund_year, donors_merged, disasters_by_country,
        joined_context, sector_totals, feature_table,
        null_profile, range_check, zero_check, join_coverage,
        duplicate_keys, duplicate_keys_unmerged, duplicate_groups,
        issues, issues_unmerged, issues_broken, sample_rows,
        filter_countries, filter_clusters, filter_years, default_selection,
        filtered_features, filtered_wide_gaps, filtered_projects, filtered_anomalies,
        kpis, kpis_filtered, gap_by_country, coverage_by_cluster, yearly_trend, metric_map,
        project_points, country_bubbles, bubble_diagonal, coverage_heatmap,
        contributions_filtered, top_funds, pledged_vs_paid,
        allocate_impact, allocate_beneficiaries, allocate_default_budget,
        allocation_totals, top_allocations, funded_lines, allocation_report, available_funding,
        ml_ready, scaler_moments, scaled_features, flag_by_contamination, flag_by_sketches,
        stored_forest_flags,
        top_costly, worst_costly, costly_by_sector, costly_summary,
        costly_score_vs_gap, costly_radar,
        nearest_center, nearest_inertia, nearest_group_sizes, label_silhouette,
        label_silhouette_sample, peer_benchmark,
        refit_centers, refit_groups, top_costly_grouped, costly_by_group,
        isolation_forest, forest_draws, forest_trees, anomalies, top_anomalies,
        top_anomalies_report, worst_anomaly,
        anomaly_summary, anomalies_by_sector, score_vs_gap, radar,
        peer_sweep, peer_groups, peer_group_sizes,
        grouped_anomalies, top_grouped_anomalies, anomalies_by_group,
    ]
}
