"""How each raw source becomes a typed frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fairshare.operators.clean import prepare

# Fixed values: (raw column, kind, column).
REQUIREMENTS = [
    ("country_code", "string", "country_code"),
    ("sector_cluster_code", "digits", "cluster_id"),
    ("sector_cluster_name", "label", "cluster_name"),
    ("date_year", "year", "year"),
    ("activity_appeal_name", "string", "appeal_name"),
    ("activity_appeal_id_fts_internal", "string", "appeal_id"),
    ("value_funding_required_usd", "number", "total_requirements_usd"),
    ("value_funding_total_usd", "number", "total_funding_usd"),
    ("value_funding_pct", "number", "funding_pct"),
]
NEEDS = [
    ("country_code", "string", "country_code"),
    ("sector_description", "string", "sector_description"),
    ("inneed", "double", "inneed"),
    ("targeted", "double", "targeted"),
    ("population", "double", "population"),
]
POPULATION = [
    ("ISO3", "string", "country_code"),
    ("Population", "double", "population"),
    ("Reference_year", "int", "ref_year"),
]
PROJECTS = [
    ("PooledFundName", "string", "country_name"),
    ("ChfProjectCode", "string", "project_code"),
    ("OrganizationName", "string", "org_name"),
    ("OrganizationType", "string", "org_type"),
    ("ProjectTitle", "string", "project_title"),
    ("AllocationYear", "int", "year"),
    ("AllocationType", "string", "allocation_type"),
    ("Budget", "double", "budget"),
    ("ProjectStatus", "string", "project_status"),
    ("Cluster", "string", "cluster"),
    ("ClusterPercentage", "double", "cluster_pct"),
    ("AdminLocation1", "string", "admin_location"),
    ("AdminLocation1Latitude", "double", "latitude"),
    ("AdminLocation1Longitude", "double", "longitude"),
    ("GenderMarker", "string", "gender_marker"),
    ("EnvironmentMarker", "string", "environment_marker"),
    ("ActualStartDate", "string", "start_date"),
    ("ActualEndDate", "string", "end_date"),
]
CONTRIBUTIONS = [
    ("PooledFundName", "string", "country_name"),
    ("PooledFundId", "int", "fund_id"),
    ("FiscalYear", "int", "year"),
    ("DonorName", "string", "donor_name"),
    ("CountryCode", "string", "donor_country_code"),
    ("PledgeAmt", "double", "pledge_usd"),
    ("PaidAmt", "double", "paid_usd"),
]
DISASTERS = [
    ("ISO", "string", "country_code"),
    ("Disaster_Type", "string", "disaster_type"),
    ("Disaster_Subtype", "string", "disaster_subtype"),
    ("Start_Year", "int", "year"),
    ("Total_Deaths", "double", "total_deaths"),
    ("Total_Affected", "double", "total_affected_disaster"),
    ("Total_Damage_000_US", "double", "total_damage_000usd"),
]


def prep_requirements(raw: DataFrame) -> DataFrame:
    return prepare(raw, REQUIREMENTS, ["country_code", "year"])


def prep_needs(raw: DataFrame) -> DataFrame:
    return prepare(raw, NEEDS)


def prep_population(raw: DataFrame) -> DataFrame:
    return prepare(raw, POPULATION)


def prep_projects(raw: DataFrame) -> DataFrame:
    return prepare(raw, PROJECTS, ["project_code", "year"])


def prep_contributions(raw: DataFrame) -> DataFrame:
    return prepare(raw, CONTRIBUTIONS, ["fund_id", "year"])


def prep_disasters(raw: DataFrame) -> DataFrame:
    return prepare(raw, DISASTERS, ["country_code", "year"])
