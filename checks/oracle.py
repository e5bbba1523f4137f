"""SQL statements of the registered queries, for an independent engine on the given tables.

Written from the definitions, not from the DataFrame code: ``proxies.py`` has the same sources.
"""

from __future__ import annotations

from checks import trees
from fairshare.functions.labels import SECTOR_MAP

UNKNOWN_LABELS = ["no such sector", "", "wash-total"]
ML_FEATURES = [
    "funding_coverage_rate", "funding_gap_pct", "beneficiary_to_funding_ratio",
    "need_to_requirements_ratio", "targeting_coverage_rate", "cost_per_beneficiary",
    "disaster_severity_score", "sector_funding_efficiency_pct", "project_vs_sector_avg",
]

# Named steps, each of which may read the ones before it.
STEPS = {
    "req_raw": """
        select n_name country_code, p_type, p_size, year(o_orderdate)::int as "year", o_orderkey,
          case when p_type = 'ECONOMY' and n_nationkey % 5 = 0 then 0::decimal(18,2)
               else l_extendedprice::decimal(18,2) end req,
          case when n_nationkey % 7 = 0 and p_type = 'PROMO' then null
               when l_returnflag = 'R' then -l_extendedprice::decimal(18,2)
               when l_returnflag = 'A' then null
               else l_extendedprice::decimal(18,2) * (1.00 - l_discount::decimal(4,2)) end fund,
          l_discount::decimal(4,2) * 100 pct
        from lineitem
        join part on l_partkey = p_partkey
        join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey""",
    "req_clean": """
        select country_code, lower(trim(p_type)) cluster_name, "year",
          o_orderkey::varchar appeal_id,
          coalesce(req::double, 0) total_requirements_usd,
          greatest(coalesce(fund::double, 0), 0) total_funding_usd,
          pct::double funding_pct
        from req_raw""",
    "merged": """
        select country_code, cluster_name, "year",
          sum(total_requirements_usd) total_requirements_usd,
          sum(total_funding_usd) total_funding_usd,
          avg(funding_pct) funding_pct,
          count(appeal_id)::bigint num_appeals
        from req_clean group by all""",
    "base": """
        select * from merged
        where not (total_requirements_usd = 0 and total_funding_usd > 0)""",
    "needs_raw": """
        select case when n_nationkey in (3, 13) then 'ELSEWHERE_' || n_nationkey else n_name end
            country_code, c_mktsegment sector_description,
          c_acctbal::decimal(18,2)::double inneed,
          (c_acctbal::decimal(18,2) * 0.6)::double targeted,
          (c_acctbal::decimal(18,2) * 10)::double population
        from customer join nation on c_nationkey = n_nationkey""",
    "needs": """
        select country_code, sum(inneed) total_inneed, sum(targeted) total_targeted,
          sum(population) hno_population
        from needs_raw group by 1""",
    "people_raw": """
        select case when n_nationkey % 11 = 0 then 'ELSEWHERE_' || n_nationkey else n_name end
            country_code, (abs(s_acctbal::decimal(18,2)) * 1000)::double population,
          (2015 + s_suppkey % 5)::int ref_year
        from supplier join nation on s_nationkey = n_nationkey""",
    "people": """
        select country_code, sum(population) total_population from people_raw group by 1""",
    "disasters_raw": """
        select case when user_id % 25 = 8 then 'ELSEWHERE_' else 'NATION_' end || (user_id % 25)
            country_code, event_type disaster_type,
          null::varchar disaster_subtype, (2015 + event_id % 10)::int as "year",
          "value" total_deaths, "value" * 1000 total_affected_disaster,
          case when event_type <> 'error' then "value" * 10 end total_damage_000usd
        from events""",
    "disasters": """
        select country_code, count(disaster_type)::bigint num_disasters_5yr,
          sum(total_deaths) total_disaster_deaths_5yr,
          sum(total_affected_disaster) total_disaster_affected_5yr,
          sum(total_damage_000usd) total_disaster_damage_000usd_5yr
        from disasters_raw where "year" >= 2019 group by 1""",
    "joined": """
        select b.*, coalesce(total_inneed, 0) total_inneed,
          coalesce(total_targeted, 0) total_targeted, hno_population,
          coalesce(total_population, 0) total_population,
          coalesce(num_disasters_5yr, 0) num_disasters_5yr,
          coalesce(total_disaster_deaths_5yr, 0) total_disaster_deaths_5yr,
          coalesce(total_disaster_affected_5yr, 0) total_disaster_affected_5yr,
          total_disaster_damage_000usd_5yr
        from base b left join needs using (country_code)
        left join people using (country_code) left join disasters using (country_code)""",
    "totals": """
        select *,
          sum(total_funding_usd) over (partition by country_code, cluster_name)
            sector_total_funding_usd,
          sum(total_requirements_usd) over (partition by country_code, cluster_name)
            sector_total_requirements_usd
        from joined""",
    "features": """
        select *,
          case when total_requirements_usd > 0
               then total_requirements_usd - total_funding_usd end funding_gap_usd,
          case when total_requirements_usd > 0 then (total_requirements_usd - total_funding_usd)
               / total_requirements_usd * 100 end funding_gap_pct,
          case when total_requirements_usd > 0
               then total_funding_usd / total_requirements_usd end funding_coverage_rate,
          case when total_funding_usd > 0
               then total_targeted / total_funding_usd end beneficiary_to_funding_ratio,
          case when total_requirements_usd > 0
               then total_inneed / total_requirements_usd end need_to_requirements_ratio,
          case when total_inneed > 0 then total_targeted / total_inneed end
            targeting_coverage_rate,
          case when total_targeted > 0 then total_funding_usd / total_targeted end
            cost_per_beneficiary,
          case when total_population > 0 then total_funding_usd / total_population end
            funding_per_capita,
          case when total_requirements_usd > 0
               then total_requirements_usd / nullif(total_population, 0) end
            requirement_per_capita,
          num_disasters_5yr * 0.4::double + total_disaster_deaths_5yr / 10000 * 0.3
            + total_disaster_affected_5yr / 1000000 * 0.3 disaster_severity_score,
          case when sector_total_requirements_usd > 0
               then sector_total_funding_usd / sector_total_requirements_usd * 100 end
            sector_funding_efficiency_pct,
          case when sector_total_requirements_usd > 0 and total_requirements_usd > 0
               then total_funding_usd / total_requirements_usd
                 - sector_total_funding_usd / sector_total_requirements_usd end
            project_vs_sector_avg
        from totals""",
    "gifts_raw": """
        select n_name country_name, n_nationkey::int fund_id, year(o_orderdate)::int as "year",
          c_mktsegment donor_name, null::varchar donor_country_code,
          o_totalprice::decimal(18,2)::double pledge_usd,
          case o_orderstatus when 'F' then o_totalprice::decimal(18,2)
            when 'P' then o_totalprice::decimal(18,2) * 0.5 end::double paid_usd
        from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey""",
    "gifts": """
        select country_name, "year", sum(pledge_usd) total_pledged_usd,
          sum(paid_usd) total_paid_usd, count(distinct donor_name)::bigint num_donors
        from gifts_raw group by all""",
    "projects": """
        select n_name country_name, p_partkey::varchar project_code, s_name org_name,
          p_brand org_type, p_name project_title, (1992 + p_partkey % 10)::int as "year",
          case when p_size > 25 then 'Standard' else 'Reserve' end allocation_type,
          p_retailprice::decimal(18,2)::double budget, 'Closed' project_status, p_type "cluster",
          p_size::double cluster_pct, 'ADM' || (p_partkey % 7) admin_location,
          case when p_partkey % 10 <> 0
               then (p_partkey * 37 % 18000)::double / 100 - 90 end latitude,
          case when p_partkey % 10 <> 0
               then (p_partkey * 91 % 36000)::double / 100 - 180 end longitude,
          '2a' gender_marker, 'A' environment_marker, '01/02/2020' start_date,
          '31/12/2020' end_date
        from part
        join supplier on s_suppkey = p_partkey % (select count(*) from supplier)
        join nation on s_nationkey = n_nationkey""",
    "first_countries": """
        select distinct country_code from features order by 1 limit 8""",
    "first_clusters": """
        select distinct cluster_name from features where cluster_name is not null
        order by 1 limit 5""",
    "last_years": """select distinct "year" from features order by 1 desc limit 2""",
    "picked": """
        select * from features
        where country_code in (from first_countries) and cluster_name in (from first_clusters)
          and "year" in (from last_years) and coalesce(funding_gap_pct, 0) >= 0""",
    "ready": f"""
        select country_code, cluster_name, "year", total_requirements_usd, total_funding_usd,
          {", ".join(ML_FEATURES)}
        from features where {" and ".join(f"{c} is not null" for c in ML_FEATURES)}""",
    "costly": """
        select *, cost_per_beneficiary - t anomaly_score,
          (cost_per_beneficiary > t)::int is_anomaly
        from ready, (select quantile_cont(cost_per_beneficiary, 0.95) t from ready)""",
    # no spread beyond rounding noise counts as none, and scales by one
    "spread": f"""
        select {", ".join(
              f"""avg({c}) m_{c}, case when var_pop({c}) <= count(*) * 2.220446049250313e-16
                * var_pop({c}) + (count(*) * avg({c}) * 2.220446049250313e-16) ** 2
                then 1 else stddev_pop({c}) end s_{c}"""
              for c in ML_FEATURES)}
        from ready""",
    "scaled": f"""
        select country_code, cluster_name, "year",
          {", ".join(f"({c} - m_{c}) / s_{c} {c}" for c in ML_FEATURES)}
        from ready, spread""",
    "lines": """
        select country_code, cluster_name,
          coalesce(sum(total_requirements_usd), 0) requirements,
          coalesce(sum(total_targeted), 0) targeted,
          coalesce(sum(total_targeted), 0) / (coalesce(sum(total_requirements_usd), 0) + 1e-9)
            impact_per_dollar
        from features where country_code is not null and cluster_name is not null
        group by all having coalesce(sum(total_requirements_usd), 0) > 0""",
    "components": """
        select vec_id, label, unnest(embedding)::double v,
          generate_subscripts(embedding, 1) pos
        from embeddings""",
    "label_means": "select label, pos, avg(v) c from components group by all",
    "near": """
        select vec_id, own, arg_min(label, d)::int cluster_id, min(d) distance
        from (select vec_id, p.label own, m.label, sum((v - c) ** 2) d
              from components p join label_means m using (pos) group by all)
        group by all""",
}


def _with(*names: str) -> str:
    """The named steps and all steps before the last of them; unused ones cost nothing."""
    order = list(STEPS)
    last = max(order.index(n) for n in names)
    return "with " + ",\n".join(f"{n} as ({STEPS[n]})" for n in order[: last + 1])


def r(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 {c}" for c in columns)


KEY = 'country_code, cluster_name, "year"'
BASE = r(4, "total_requirements_usd", "total_funding_usd", "funding_pct")
CONTEXT = r(
    3, "total_inneed", "total_targeted", "hno_population", "total_population",
    "total_disaster_deaths_5yr", "total_disaster_affected_5yr",
    "total_disaster_damage_000usd_5yr",
)
RATIOS = [
    "funding_gap_usd", "funding_gap_pct", "funding_coverage_rate",
    "beneficiary_to_funding_ratio", "need_to_requirements_ratio", "targeting_coverage_rate",
    "cost_per_beneficiary", "funding_per_capita", "requirement_per_capita",
    "disaster_severity_score", "sector_funding_efficiency_pct", "project_vs_sector_avg",
]
NULL_COLUMNS = [
    "country_code", "cluster_name", "year", "total_requirements_usd", "total_funding_usd",
    "total_inneed", "total_targeted", "total_population", *RATIOS,
]
BOUNDS = {
    "funding_coverage_rate": (0, 10),
    "funding_gap_pct": (-10, 100),
    "targeting_coverage_rate": (0, 2),
    "total_funding_usd": (0, None),
    "total_requirements_usd": (0, None),
    "total_inneed": (0, None),
    "total_targeted": (0, None),
    "cost_per_beneficiary": (0, None),
    "disaster_severity_score": (0, None),
}
ZEROS = ["total_requirements_usd", "total_funding_usd", "total_population", "total_inneed"]
JOINS = {
    "HNO (total_inneed)": "total_inneed",
    "Population (total_population)": "total_population",
    "EMDAT (disaster_severity)": "disaster_severity_score",
}
SAMPLE = r(
    4, "total_requirements_usd", "total_funding_usd", "funding_gap_pct",
    "funding_coverage_rate", "beneficiary_to_funding_ratio", "disaster_severity_score",
)
RADAR = [
    "funding_coverage_rate", "funding_gap_pct", "beneficiary_to_funding_ratio",
    "need_to_requirements_ratio", "targeting_coverage_rate", "disaster_severity_score",
]
MAP_METRICS = [
    "funding_gap_pct", "funding_coverage_rate", "total_funding_usd",
    "total_requirements_usd", "disaster_severity_score", "total_inneed",
]
CLUSTERS = ["economy", "large", "medium", "promo", "small", "standard"]
LABEL = """case lower(trim(sector_description)) when 'automobile' then 'logistics'
    when 'building' then 'shelter and nfi' when 'household' then 'wash'
    when 'machinery' then 'logistics' end"""


def _sector_labels() -> str:
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in [*SECTOR_MAP, *UNKNOWN_LABELS])
    known = ", ".join("('" + "', '".join(x.replace("'", "''") for x in pair) + "')" for pair in SECTOR_MAP.items())
    n = len(SECTOR_MAP) + len(UNKNOWN_LABELS)
    return f"""with raw as (
        select o_custkey % 3 k, ([{listed}])[o_orderkey % {n} + 1] l from orders),
      spelled as (select case k when 0 then upper(l) when 1 then '  ' || l || ' ' else l end "label" from raw),
      known(l, sector) as (values {known})
      select "label", sector, count(*)::bigint "rows"
      from spelled left join known on known.l = lower(trim("label")) group by all"""


def _union(parts) -> str:
    return "\nunion all\n".join(parts)


def _issue_parts(rows: str, nulls, bounds, joins) -> str:
    parts = []
    for c in nulls:
        pct = f'count(*) filter ("{c}" is null) * 100.0::double / count(*)'
        parts.append(
            f"""select 'high null rate' "check", '{c}' "column", {pct} "value", '<60' expected
            from {rows} having {pct} >= 60"""
        )
    for c, (low, high) in bounds.items():
        for bound, fn, sign, bad in ((low, "min", ">=", "<"), (high, "max", "<=", ">")):
            if bound is not None:
                parts.append(
                    f"""select 'out of range', '{c}', {fn}({c}), '{sign}{float(bound)}'
                    from {rows} having {fn}({c}) {bad} {bound}"""
                )
    for label, c in joins.items():
        pct = f"count(*) filter ({c} > 0) * 100.0::double / count(*)"
        parts.append(
            f"""select 'low join coverage', '{label}', {pct}, '>=10' from {rows}
            having {pct} < 10"""
        )
    parts.append(
        f"""select 'duplicate keys', 'country_code, cluster_name, year',
          (sum(n) - count(*))::double, '0'
        from (select count(*) n from {rows} group by {KEY}) having sum(n) > count(*)"""
    )
    return f'select "check", "column", round("value", 4) + 0.0 "value", expected from ({_union(parts)})'


def _broken() -> str:
    """Feature rows that break every rule, each twice."""

    def beyond(c: str) -> str:
        low, high = BOUNDS.get(c, (0, None))
        value = low - 1 if high is None else f"case when num_appeals % 2 = 0 then {low - 1} else {high + 1} end"
        return f'case when "year" % 4 = 1 then {value} end::double "{c}"'

    columns = [c for c in dict.fromkeys([*NULL_COLUMNS, *BOUNDS]) if c not in NULL_COLUMNS[:3]]
    keys = """case when "year" % 4 = 1 then country_code end country_code, null::varchar cluster_name,
        case when "year" % 4 = 1 then "year" end "year\""""
    once = f"select {keys}, {', '.join(beyond(c) for c in columns)} from features"
    return f"broken as ({once} union all {once})"


def _allocation(objective: str, budget: str, body: str) -> str:
    value = "impact_per_dollar" if objective == "impact" else "targeted"
    return f"""{_with("lines")}, ordered as (
        select *, {value} / requirements worth,
          coalesce(sum(requirements) over (order by {value} / requirements desc, country_code,
            cluster_name rows between unbounded preceding and 1 preceding), 0) spent
        from lines),
      shared as (
        select country_code, cluster_name, requirements, targeted, impact_per_dollar,
          case when worth > 0
               then greatest(0, least(1, (({budget}) - spent) / requirements))
               else 0 end::double allocation
        from ordered),
      alloc as (
        select *, allocation * requirements allocated_usd,
          allocation * targeted expected_beneficiaries
        from shared)
      {body}"""


FORTY = "select 0.4 * sum(requirements) from lines"
ALLOC_COLUMNS = (
    "country_code, cluster_name, "
    + r(4, "requirements", "targeted", "allocated_usd", "expected_beneficiaries")
    + ", "
    + r(6, "impact_per_dollar", "allocation")
)


def _heatmap() -> str:
    grid = ", ".join(
        f"coalesce(avg(funding_coverage_rate) filter (cluster_name = '{c}'), 0) {c}"
        for c in CLUSTERS
    )
    mean = "(" + " + ".join(CLUSTERS) + f") / {len(CLUSTERS)}"
    return f"""{_with("features")}, grid as (
        select country_code, {grid} from features
        where cluster_name is not null group by 1)
      select country_code, {r(6, *CLUSTERS)}, round({mean}, 6) + 0.0 row_mean
      from grid order by {mean}, country_code limit 20"""


def _radar() -> str:
    worst = ", ".join(RADAR)
    means = ", ".join(f"avg({c}) {c}" for c in RADAR)
    low, high = f"least({worst})", f"greatest({worst})"
    rows = _union(
        f"""select profile, '{c}' feature,
          round(case when {high} > {low} then ({c} - {low}) / ({high} - {low}) else 0 end, 6) + 0.0
            "value" from both_rows"""
        for c in RADAR
    )
    return f"""{_with("costly")}, both_rows as (
        (select 'Worst Anomaly' profile, {worst} from costly where is_anomaly = 1
         order by anomaly_score desc, {KEY} limit 1)
        union all select 'Average', {means} from costly)
      {rows}"""


def _benchmark() -> str:
    far = " + ".join(f"(s.{c} - m.{c}) ** 2" for c in ML_FEATURES)
    gaps = ", ".join(
        f"round({c} - avg({c}) over (partition by cluster_id), 5) + 0.0 {c}_vs_peers"
        for c in ML_FEATURES
    )
    means = ", ".join(f"avg({c}) {c}" for c in ML_FEATURES)
    return f"""{_with("scaled")}, centers as (
        select (row_number() over (order by cluster_name) - 1)::int id, * from
          (select cluster_name, {means} from scaled group by 1)),
      grouped as (
        select s.*, (select arg_min(m.id, {far}) from centers m) cluster_id from scaled s)
      select {KEY}, cluster_id, {gaps} from grouped"""


def _refit(rows: str, steps: int = 5) -> str:
    """Groups that start at the means of the sectors and move ``steps`` times; ``rows`` reads what comes of it."""
    far = " + ".join(f"(s.{c} - m.{c}) ** 2" for c in ML_FEATURES)
    means = ", ".join(f"avg({c}) {c}" for c in ML_FEATURES)
    moved = ", ".join(f"coalesce(avg(s.{c}), any_value(m.{c})) {c}" for c in ML_FEATURES)
    parts = [_with("scaled"), f"""c0 as materialized (
        select (row_number() over (order by cluster_name) - 1)::int id, {", ".join(ML_FEATURES)}
        from (select cluster_name, {means} from scaled group by 1))"""]
    for k in range(steps + 1):
        parts.append(f"""g{k} as materialized (
          select s.*, (select arg_min(m.id, {far}) from c{k} m) cluster_id from scaled s)""")
        if k < steps:
            parts.append(f"""c{k + 1} as materialized (
              select m.id, {moved} from c{k} m left join g{k} s on s.cluster_id = m.id group by m.id)""")
    return ", ".join(parts) + rows.format(centers=f"c{steps}", groups=f"g{steps}")


def _draws() -> str:
    """Draws of all rows for all trees, by the digest of their keys."""
    part = "case when {c} is null then 'null' else length({c}::varchar) || ':' || {c}::varchar end"
    digest = " || '|' || ".join(part.format(c=c) for c in KEY.split(", "))
    return f"""{_with("ready")}, hashed as (select {KEY}, md5('42|' || {digest}) d from ready),
      draws as (
        select {KEY}, tree, row_number() over (partition by tree order by
          (('0x' || substr(d, 1, 12))::bigint + tree * (('0x' || substr(d, 13, 12))::bigint | 1)) % 281474976710656, d) n
        from hashed, range(100) t(tree) qualify n <= 256)"""


def _silhouette(distance: str, rows: str = "select vec_id from embeddings") -> str:
    return f"""{_with("components")}, drawn as ({rows}),
      points as (select * from components where vec_id in (select vec_id from drawn)),
      pairs as (
        select a.vec_id, a.label own, b.label other, {distance} d
        from points a join points b on a.pos = b.pos and a.vec_id <> b.vec_id
        group by a.vec_id, b.vec_id, a.label, b.label),
      reach as (select vec_id, own, other, avg(d) d from pairs group by all),
      sides as (
        select vec_id, min(d) filter (own = other) near, min(d) filter (own <> other) far
        from reach group by 1)
      select 'label' "labels",
        round(avg(case when near is null then 0
          else (far - near) / greatest(far, near) end), 6) + 0.0 silhouette
      from sides"""


def _profile(row: str, columns) -> str:
    return f"{_with('features')} " + _union(row.format(c=c) for c in columns)


def _ranges() -> str:
    parts = []
    for c, (low, high) in BOUNDS.items():
        bad = " or ".join(
            ([f"min({c}) < {low}"] if low is not None else [])
            + ([f"max({c}) > {high}"] if high is not None else [])
        )
        parts.append(
            f"""select '{c}' "column", round(min({c}), 2) + 0.0 min_val,
            round(max({c}), 2) + 0.0 max_val, round(avg({c}), 2) + 0.0 avg_val,
            round(stddev_samp({c}), 2) + 0.0 std_val,
            count(*) filter ({c} < 0)::bigint neg_count,
            case when {bad} then 'fail' else 'ok' end status from features"""
        )
    return f"{_with('features')} {_union(parts)}"


def _duplicates(rows: str) -> str:
    return f"""{_with(rows)} select sum(n)::bigint total_rows, count(*)::bigint distinct_keys,
        (sum(n) - count(*))::bigint duplicates,
        case when sum(n) = count(*) then 'ok' else 'warn' end status
      from (select count(*) n from {rows} group by {KEY})"""


def _kpis(rows: str, flags: str) -> str:
    return f"""select coalesce(sum(total_requirements_usd), 0) total_requirements_usd,
        coalesce(sum(total_funding_usd), 0) total_funding_usd,
        coalesce(sum(funding_gap_usd), 0) total_gap_usd,
        avg(funding_coverage_rate) * 100 avg_coverage_pct,
        coalesce(sum(total_inneed), 0) total_inneed,
        (select coalesce(sum(is_anomaly), 0) from {flags})::bigint anomalies_flagged
      from {rows}"""


def _money_by(key: str) -> str:
    return f"""select {key}, coalesce(sum(total_requirements_usd), 0) requirements,
        coalesce(sum(total_funding_usd), 0) funding
      from features where {key} is not null group by 1"""


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

#: Columns of the given tables that hold numbers, and others that are not nested.
NUMBERS = {
    "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey c_acctbal",
    "supplier": "s_suppkey s_nationkey s_acctbal", "part": "p_partkey p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_totalprice",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
    "events": "event_id user_id value", "documents": "doc_id n_chars", "embeddings": "vec_id label",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id quality toxic", "conversations": "conv_id turn",
}
OTHERS = {
    "region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name",
    "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderdate o_orderpriority",
    "lineitem": "l_returnflag l_linestatus l_shipdate", "events": "ts event_type props",
    "documents": "text lang source", "pages": "url html", "benchmark": "text", "conversations": "role text",
}


def _table_statistics() -> str:
    def part(table: str, column: str, ends: tuple[str, str]) -> str:
        return f"""select '{table}' dataset, '{column}' "column", count(*)::bigint "rows",
            count("{column}")::bigint filled, {ends[0]}::double least, {ends[1]}::double most from {table}"""

    parts = [part(t, c, (f'min("{c}")', f'max("{c}")')) for t, names in NUMBERS.items() for c in names.split()]
    parts += [part(t, c, ("null", "null")) for t, names in OTHERS.items() for c in names.split()]
    return " union all ".join(parts)


def _leaf(tree) -> str:
    """The path length of a row in a tree; nulls and NaN go left."""
    if isinstance(tree, float):
        return f"{tree}::double"
    feature, threshold, low, high = tree
    right = f"{feature} > {threshold} and not isnan({feature})"
    return f"(case when {right} then {_leaf(high)} else {_leaf(low)} end)"


def _stored_forest() -> str:
    n, paths = trees.SAMPLE, " + ".join(_leaf(t) for t in trees.TREES)
    norm = f"(2 * (ln({n - 1}) + 0.5772156649015329) - 2 * {n - 1}::double / {n})"
    return f"""
        with cells as (
          select l_orderkey, l_linenumber,
            case when l_linenumber <> 4 then l_quantity::double end quantity,
            l_extendedprice::double price,
            case when l_linenumber = 2 then 'nan'::double else l_discount::double end discount
          from lineitem),
        scored as (
          select l_orderkey, l_linenumber, 2 ** (-({paths}) / {len(trees.TREES)} / {norm}) s from cells)
        select l_orderkey, l_linenumber, round(s, 9) + 0.0 raw_score,
          round(s - {trees.FLAG_ABOVE}::double, 9) + 0.0 anomaly_score, (s > {trees.FLAG_ABOVE})::int is_anomaly
        from scored"""


SQL: dict[str, str] = {
    "coerce_orders": """
        select o_orderkey order_id, o_totalprice::decimal(18,2)::double price,
          o_orderstatus status,
          case when o_orderkey % 10 <> 0 then o_custkey else -1 end mostly_numbers,
          case when o_orderkey % 2 = 0 then 'unknown' else o_custkey::varchar end half_numbers,
          o_custkey::varchar country_code
        from orders""",
    "coerce_long_codes": """
        select 1000000000000000000 + l_orderkey * 10 + l_linenumber code,
          l_quantity::double quantity from lineitem""",
    "ingested_orders": """
        select o_orderkey "Order_ID", o_orderstatus "Status",
          o_totalprice::decimal(18,2)::double "Price",
          case when o_orderkey % 5 <> 0 then 'a "quoted", part' || chr(10) || o_custkey end "Note",
          'given' origin from orders""",
    "ingested_tagged": """
        with s as (
          select s_nationkey, count(*) suppliers, round(sum(s_acctbal::decimal(18,2)), 2)::double + 0.0 balance,
            min(s_name) first_name from supplier group by 1)
        select c_custkey cust_id, c_name org_name, '#' || c_mktsegment org_name_1, lpad(c_nationkey::varchar, 3, '0') adm1_code,
          c_acctbal::decimal(18,2)::double value__usd, suppliers, balance, first_name
        from customer left join s on s_nationkey = c_nationkey""",
    "flag_with_gaps": """
        with v as (select l_orderkey, l_linenumber, case when l_orderkey % 7 = 0 then null
            when l_orderkey % 7 = 1 then 'nan'::double when l_orderkey % 7 = 2 then 'inf'::double
            else l_extendedprice::double end x from lineitem),
        t as (select quantile_cont(x, 0.5) t from v where x is not null and not isnan(x))
        select l_orderkey, l_linenumber,
          case when x is not null and not isnan(x) and x > t then 1 else 0 end is_anomaly from v, t""",
    "nearest_center_with_gaps": _with("near") + """
        select vec_id, case when vec_id % 3 <> 0 then cluster_id else -1 end cluster_id from near""",
    "dataset_summary": _union(
        f"""select '{t}' dataset, (select count(*)::bigint from {t}) "rows", count(*)::int cols,
          'struct<' || string_agg(name || ':' || case type
            when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'FLOAT[]' then 'array<float>'
            when 'TIMESTAMP' then 'timestamp_ntz' else lower(type) end, ',' order by cid) || '>' "schema"
        from pragma_table_info('{t}')"""
        for t in TABLES
    ),
    "table_statistics": _table_statistics(),
    "prep_requirements": _with("req_raw") + """
        select country_code, case when p_size % 2 = 0 then p_size::varchar end cluster_id,
          lower(p_type) cluster_name, "year", 'Appeal ' || o_orderkey appeal_name,
          o_orderkey::varchar appeal_id, req::double total_requirements_usd,
          fund::double total_funding_usd, pct::double funding_pct
        from req_raw where o_orderkey % 11 <> 0""",
    "prep_needs": _with("needs_raw") + " select * from needs_raw",
    "prep_population": _with("people_raw") + " select * from people_raw",
    "prep_projects": _with("projects") + " select * from projects",
    "prep_contributions": _with("gifts_raw") + " select * from gifts_raw",
    "prep_disasters": _with("disasters_raw") + " select * from disasters_raw",
    "canonical_labels": _with("needs_raw") + f"""
        select country_code, sector_description, {LABEL} sector, count(*)::bigint "rows"
        from needs_raw group by all""",
    "sector_labels": _sector_labels(),
    "allocation_report": _allocation("impact", FORTY, f"""
        select country_code "Country", cluster_name "Cluster",
          '$' || format('{{:,.0f}}', requirements) "Requirements",
          '$' || format('{{:,.0f}}', allocated_usd) "Allocated",
          format('{{:.1f}}', allocation * 100) || '%' "Allocation %",
          format('{{:,.0f}}', expected_beneficiaries) "Exp. Beneficiaries",
          format('{{:.4f}}', impact_per_dollar) "Impact/Dollar"
        from (select {ALLOC_COLUMNS} from alloc)"""),
    "cleaned_requirements": _with("req_clean") + """
        select appeal_id, cluster_name, "year", total_requirements_usd, total_funding_usd
        from req_clean""",
    "merged_requirements": _with("merged") + f"select {KEY}, {BASE}, num_appeals from merged",
    "unbacked_rows": _with("base") + """
        select (select count(*) from merged)::bigint rows_before,
          (select count(*) from base)::bigint rows_after,
          ((select count(*) from merged) - (select count(*) from base))::bigint dropped""",
    "base_requirements": _with("base") + f"select {KEY}, {BASE}, num_appeals from base",
    "needs_by_country": _with("needs") + f"""
        select country_code, {r(3, "total_inneed", "total_targeted", "hno_population")}
        from needs""",
    "needs_by_sector": _with("needs_raw") + f"""
        select country_code, {LABEL} sector, round(sum(inneed), 3) + 0.0 total_inneed,
          round(sum(targeted), 3) + 0.0 total_targeted,
          round(sum(population), 3) + 0.0 hno_population
        from needs_raw group by all""",
    "population_by_country": _with("people")
    + f"select country_code, {r(2, 'total_population')} from people",
    "latest_population": _with("people_raw") + """
        select country_code, round(sum(population), 2) + 0.0 total_population
        from people_raw p
        where ref_year = (select max(ref_year) from people_raw q
                          where q.country_code = p.country_code)
        group by 1""",
    "contributions_by_fund_year": _with("gifts") + f"""
        select country_name, "year", {r(3, "total_pledged_usd", "total_paid_usd")}, num_donors
        from gifts""",
    "disasters_by_country": _with("disasters") + f"""
        select country_code, num_disasters_5yr, {r(3, "total_disaster_deaths_5yr",
          "total_disaster_affected_5yr", "total_disaster_damage_000usd_5yr")} from disasters""",
    "joined_context": _with("joined")
    + f"select {KEY}, num_appeals, num_disasters_5yr, {BASE}, {CONTEXT} from joined",
    "sector_totals": _with("totals") + f"""
        select {KEY}, {r(4, "sector_total_funding_usd", "sector_total_requirements_usd")}
        from totals""",
    "feature_table": _with("features")
    + f"select {KEY}, num_appeals, num_disasters_5yr, {r(5, *RATIOS)} from features",
    "null_profile": _profile(
        """select '{c}' "column", count(*) filter ("{c}" is null)::bigint nulls,
        round(count(*) filter ("{c}" is null) * 100.0::double / count(*), 6) + 0.0 null_pct,
        case when count(*) filter ("{c}" is null) * 100.0 / count(*) < 20 then 'ok'
             when count(*) filter ("{c}" is null) * 100.0 / count(*) < 60 then 'warn'
             else 'fail' end status from features""",
        NULL_COLUMNS,
    ),
    "range_check": _ranges(),
    "zero_check": _profile(
        """select '{c}' "column", count(*) filter (coalesce({c}, 0) = 0)::bigint zeros,
        round(count(*) filter (coalesce({c}, 0) = 0) * 100.0::double / count(*), 6) + 0.0
          zero_pct,
        case when count(*) filter (coalesce({c}, 0) = 0) * 100.0 / count(*) < 30 then 'ok'
             when count(*) filter (coalesce({c}, 0) = 0) * 100.0 / count(*) < 60 then 'warn'
             else 'fail' end status from features""",
        ZEROS,
    ),
    "join_coverage": f"{_with('features')} "
    + _union(
        f"""select '{label}' "label", '{c}' "column",
        count(*) filter ({c} > 0)::bigint matched,
        round(count(*) filter ({c} > 0) * 100.0::double / count(*), 6) + 0.0 match_pct,
        case when count(*) filter ({c} > 0) * 100.0 / count(*) > 30 then 'ok'
             when count(*) filter ({c} > 0) * 100.0 / count(*) > 10 then 'warn'
             else 'fail' end status from features"""
        for label, c in JOINS.items()
    ),
    "duplicate_keys": _duplicates("features"),
    "duplicate_keys_unmerged": _duplicates("req_clean"),
    "duplicate_groups": _with("req_clean") + f"""
        select {KEY}, count(*)::bigint "count" from req_clean group by all
        having count(*) > 1 order by 4 desc, 1, 2, 3 limit 10""",
    "issues": f"{_with('features')} " + _issue_parts("features", NULL_COLUMNS, BOUNDS, JOINS),
    "issues_unmerged": f"{_with('req_clean')} " + _issue_parts(
        "req_clean", NULL_COLUMNS[:5],
        {c: BOUNDS[c] for c in ("total_funding_usd", "total_requirements_usd")}, {}),
    "issues_broken": f"{_with('features')}, {_broken()} "
    + _issue_parts("broken", NULL_COLUMNS, BOUNDS, JOINS),
    "sample_rows": _with("features") + f"""
        select {KEY}, {SAMPLE} from features where total_funding_usd > 0
        order by 1, 2 nulls first, 3 limit 10""",
    "filter_countries": _with("features") + "select distinct country_code from features",
    "filter_clusters": _with("features")
    + "select distinct cluster_name from features where cluster_name is not null",
    "filter_years": _with("features") + 'select distinct "year" from features',
    "default_selection": _with("picked")
    + f'select {KEY}, count(*)::bigint "rows" from picked group by all',
    "filtered_features": _with("picked") + f"select {KEY}, {r(5, 'funding_gap_pct')} from picked",
    "filtered_wide_gaps": _with("picked") + f"""
        select {KEY}, {r(5, 'funding_gap_pct')} from picked where funding_gap_pct >= 50""",
    "filtered_projects": _with("last_years") + """
        select project_code, country_name, "year", "cluster", budget from projects
        where country_name in (from first_countries) and "year" in (from last_years)""",
    "filtered_anomalies": _with("costly") + f"""
        select {KEY}, is_anomaly from costly
        where country_code in (from first_countries) and cluster_name in (from first_clusters)
          and funding_gap_pct >= 0 and is_anomaly = 1""",
    "kpis": _with("costly") + f""", k as ({_kpis("features", "costly")})
        select {r(4, "total_requirements_usd", "total_funding_usd", "total_gap_usd",
                  "total_inneed")}, {r(6, "avg_coverage_pct")}, anomalies_flagged from k""",
    "kpis_filtered": _with("costly") + f""", flags as (
          select * from costly
          where country_code in (from first_countries) and cluster_name in (from first_clusters)
            and "year" in (from last_years) and funding_gap_pct >= 0),
        k as ({_kpis("picked", "flags")})
        select round(total_requirements_usd / 1e9, 6) + 0.0 requirements_bn,
          round(total_funding_usd / 1e9, 6) + 0.0 funded_bn,
          round(total_gap_usd / 1e9, 6) + 0.0 gap_bn, {r(6, "avg_coverage_pct")},
          round(total_inneed / 1e6, 6) + 0.0 inneed_mn, anomalies_flagged from k""",
    "gap_by_country": _with("features") + f""", m as ({_money_by("country_code")})
        select country_code, {r(4, "requirements", "funding")},
          round((requirements - funding) / (requirements + 1e-9) * 100, 6) + 0.0 gap_pct
        from m order by (requirements - funding) / (requirements + 1e-9) desc, 1 limit 20""",
    "coverage_by_cluster": _with("features") + f""", m as ({_money_by("cluster_name")})
        select cluster_name, {r(4, "requirements", "funding")},
          round(funding / (requirements + 1e-9) * 100, 6) + 0.0 coverage from m""",
    "yearly_trend": _with("features") + f""", m as ({_money_by('"year"')})
        select "year", {r(4, "requirements", "funding")},
          round(requirements / 1e9, 8) + 0.0 requirements_bn,
          round(funding / 1e9, 8) + 0.0 funding_bn from m""",
    "metric_map": f"{_with('features')} " + _union(
        f"""select '{m}' metric, country_code, round(avg({m}) * (1 + 1e-12), 4) + 0.0 "value",
        '{m.replace("_", " ").title()}' "label" from features group by 2"""
        for m in MAP_METRICS
    ),
    "project_points": _with("projects") + """
        select project_code, latitude, longitude, "cluster", budget, org_name from projects
        where latitude is not null and longitude is not null order by 1 limit 1000""",
    "country_bubbles": _with("features") + """
        select country_code, round(sum(total_requirements_usd), 4) + 0.0 requirements,
          round(sum(total_funding_usd), 4) + 0.0 funding,
          round(sum(total_inneed), 4) + 0.0 inneed from features group by 1""",
    "bubble_diagonal": _with("features") + f""", m as ({_money_by("country_code")})
        select round(greatest(max(requirements), max(funding)), 4) + 0.0 max_val from m""",
    "coverage_heatmap": _heatmap(),
    "contributions_filtered": _with("last_years") + f"""
        select country_name, "year", {r(3, "total_pledged_usd", "total_paid_usd")}, num_donors
        from gifts where "year" in (from last_years)""",
    "top_funds": _with("last_years") + """
        select country_name, round(coalesce(sum(total_paid_usd), 0), 3) + 0.0 total_paid_usd
        from gifts where "year" in (from last_years) group by 1
        order by coalesce(sum(total_paid_usd), 0) desc, 1 limit 15""",
    "pledged_vs_paid": _with("gifts") + """
        select "year", round(coalesce(sum(total_pledged_usd), 0) / 1e6, 6) + 0.0 pledged_mn,
          round(coalesce(sum(total_paid_usd), 0) / 1e6, 6) + 0.0 paid_mn
        from gifts group by 1""",
    "allocate_impact": _allocation("impact", FORTY, f"select {ALLOC_COLUMNS} from alloc"),
    "allocate_beneficiaries": _allocation(
        "beneficiaries", FORTY, f"select {ALLOC_COLUMNS} from alloc"),
    "allocate_default_budget": _allocation(
        "impact", "select sum(total_funding_usd) from features",
        f"select {ALLOC_COLUMNS} from alloc"),
    "allocation_totals": _allocation("impact", FORTY, """
        select round(sum(expected_beneficiaries), 4) + 0.0 total_beneficiaries,
          round(sum(allocated_usd), 4) + 0.0 total_allocated,
          round(sum(expected_beneficiaries) / greatest(sum(allocated_usd), 1), 6) + 0.0
            impact_per_dollar
        from alloc"""),
    "top_allocations": _allocation("impact", FORTY, f"""
        select {ALLOC_COLUMNS} from alloc a where a.allocation > 0.01
        order by a.expected_beneficiaries desc, country_code, cluster_name limit 20"""),
    "funded_lines": _allocation(
        "impact", FORTY, f"select {ALLOC_COLUMNS} from alloc a where a.allocation > 0.01"),
    "available_funding": _with("features")
    + "select round(sum(total_funding_usd), 4) + 0.0 budget_usd from features",
    "ml_ready": _with("ready") + f"""
        select {KEY}, {r(4, "total_requirements_usd", "total_funding_usd", *ML_FEATURES)}
        from ready""",
    "scaler_moments": f"{_with('ready')} " + _union(
        f"""select '{c}' "column", round(avg({c}), 5) + 0.0 "mean",
        round(stddev_pop({c}), 5) + 0.0 deviation from ready"""
        for c in ML_FEATURES
    ),
    "scaled_features": _with("scaled") + f"select {KEY}, {r(6, *ML_FEATURES)} from scaled",
    "flag_by_contamination": """
        select l_orderkey, l_linenumber, l_extendedprice,
          round(l_extendedprice - t, 4) + 0.0 anomaly_score,
          (l_extendedprice > t)::int is_anomaly
        from lineitem, (select quantile_cont(l_extendedprice, 0.95) t from lineitem)""",
    "top_costly": _with("costly") + f"""
        select {KEY}, {r(4, "total_requirements_usd", "total_funding_usd", "funding_gap_pct",
                         "anomaly_score")}
        from costly c where is_anomaly = 1
        order by c.anomaly_score desc, 1, 2 nulls first, 3 limit 20""",
    "worst_costly": _with("costly") + f"""
        select {KEY}, {r(4, "anomaly_score")} from costly c where is_anomaly = 1
        order by c.anomaly_score desc, 1, 2 nulls first, 3 limit 1""",
    "costly_by_sector": _with("costly") + """
        select cluster_name, count(*)::bigint "count" from costly where is_anomaly = 1
        group by 1""",
    "costly_summary": _with("costly") + """
        select sum(is_anomaly)::bigint anomaly_count,
          round(avg(is_anomaly), 8) + 0.0 anomaly_rate from costly""",
    "costly_score_vs_gap": _with("costly") + f"""
        select {KEY}, {r(4, "funding_gap_pct", "anomaly_score")}, is_anomaly from costly""",
    "costly_radar": _radar(),
    "nearest_center": _with("near")
    + f"select vec_id, cluster_id, {r(6, 'distance')} from near",
    "nearest_inertia": _with("near") + "select round(sum(distance), 4) + 0.0 inertia from near",
    "nearest_group_sizes": _with("near") + """
        select cluster_id, own "label", count(*)::bigint "count" from near group by all""",
    "stored_forest_flags": _stored_forest(),
    "flag_by_sketches": """
        select l_orderkey, l_linenumber, l_extendedprice,
          round(l_extendedprice - t, 4) + 0.0 anomaly_score,
          (l_extendedprice > t)::int is_anomaly
        from lineitem, (select quantile_cont(l_extendedprice, 0.95) t from lineitem)""",
    "donors_merged": """
        with g as (
          select n_name, year(o_orderdate)::varchar y, case when o_custkey % 10 <> 0 then o_custkey end d
          from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
        select 'fund' "level", n_name "name", count(distinct d) num_donors, true near from g group by 2
        union all select 'year', y, count(distinct d), true from g group by 2
        union all select 'all', '', count(distinct d), true from g""",
    "forest_draws": _draws() + f""" select {KEY}, count(*) trees, sum(n)::bigint ranks from draws group by {KEY}""",
    "forest_trees": _draws() + " select tree::int tree, 1 as \"binary\", count(*) sample from draws group by tree",
    "label_silhouette": _silhouette("sum((a.v - b.v) ** 2)"),
    "label_silhouette_sample": _silhouette(
        "sqrt(sum((a.v - b.v) ** 2))",
        """select vec_id from embeddings
        order by md5('42|' || length(vec_id::varchar) || ':' || vec_id::varchar), vec_id limit 5000""",
    ),
    "peer_benchmark": _benchmark(),
    "refit_centers": _refit(" select id cluster_id, " + r(6, *ML_FEATURES) + " from {centers}"),
    "refit_groups": _refit(f" select {KEY}, cluster_id from {{groups}}"),
    "top_costly_grouped": _refit(f""" select {KEY},
        {r(4, "total_requirements_usd", "total_funding_usd", "c.funding_gap_pct", "anomaly_score").replace("0.0 c.", "0.0 ")},
        cluster_id from costly c join (select {KEY}, cluster_id from {{groups}}) using ({KEY})
        where is_anomaly = 1 order by c.anomaly_score desc, {KEY} limit 20"""),
    "costly_by_group": _refit(f""" select cluster_id, is_anomaly, count(*)::bigint "count"
        from costly join (select {KEY}, cluster_id from {{groups}}) using ({KEY}) group by all"""),
}
