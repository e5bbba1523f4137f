import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairshare.plans import tables
from fairshare.sources import ingest as ing
from fairshare.sources.coerce import safe_coerce
from fairshare.sources.csv import load_csv, load_hxl, parts_by_scan, spans_lines
from fairshare.sources.names import plain_name, punctuated_name, tag_name, unique_names
from fairshare.sources.statistics import PUSHDOWN, file_statistics, footer_totals
from fairshare.sources.tables import (
    drop_old_versions,
    drop_table,
    read_tables,
    register_views,
    settle,
    shared_dir,
    shown_version,
    write_table,
)


def put(folder, name, text, bom=False):
    path = folder / name
    path.write_bytes(text.encode("utf-8-sig" if bom else "utf-8"))
    return str(path)


HXL = (
    "Country,Sector name,In need\n"
    "#country+code,#sector +name,#inneed\n"
    'AFG,"Water, sanitation","1,200"\n'
    "#odd,x,3\n"
    ",,\n"
    "NA,Health,n/a\n"
)


def test_names():
    assert tag_name(" #country+code ") == "country_code"
    assert plain_name(" Pooled Fund ") == "Pooled_Fund"
    assert punctuated_name("Total Damage ('000 US$)") == "Total_Damage_000_US"
    assert punctuated_name("No. Affected") == "No_Affected"
    assert punctuated_name("AID/Other, Adjusted") == "AID_Other_Adjusted"
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert unique_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]


@given(st.lists(st.sampled_from(["a", "b", "a_1", "a_2", ""])))
def test_names_become_unique(names):
    got = unique_names(names)
    assert len(set(got)) == len(got) == len(names)
    assert all(new.startswith(old) for new, old in zip(got, names))


def test_hxl(spark, tmp_path):
    df = load_hxl(spark, put(tmp_path, "h.csv", HXL, bom=True))
    assert df.columns == ["country_code", "sector__name", "inneed"]
    assert [tuple(r) for r in df.collect()] == [
        ("AFG", "Water, sanitation", "1,200"),
        ("#odd", "x", "3"),
        (None, None, None),
        (None, "Health", None),
    ]


def test_hxl_without_tags(spark, tmp_path):
    df = load_hxl(spark, put(tmp_path, "p.csv", "ISO3,Some Name\nAFG,1\n"))
    assert df.columns == ["ISO3", "Some_Name"] and df.count() == 1


def test_plain_with_repeated_names_and_quotes(spark, tmp_path):
    text = ' a ,a,b c\n1,"say ""hi""",back\\slash\n'
    df = load_csv(spark, put(tmp_path, "p.csv", text))
    assert df.columns == ["a", "a_1", "b_c"]
    assert tuple(df.first()) == ("1", 'say "hi"', "back\\slash")


def test_records_over_several_lines_are_noticed(spark, tmp_path):
    path = put(tmp_path, "m.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    assert spans_lines(spark, path)
    assert [tuple(r) for r in load_csv(spark, path).collect()] == [("1", "two\nlines"), ("2", "x")]
    assert not spans_lines(spark, put(tmp_path, "s.csv", 'a,b\n1,"x, ""y"""\n'))


def test_headers_of_every_file_are_dropped(spark, tmp_path):
    put(tmp_path, "1.csv", HXL)
    put(tmp_path, "2.csv", HXL)
    assert load_hxl(spark, str(tmp_path)).count() == 8


def test_coerce(rows):
    def column(good, bad):
        return ["1,000"] * good + ["?"] * bad

    names = ["p79", "p80", "p81", "empty", "iso3", "real", "odd"]
    odd = ["1e5", "12d", "NaN", "inf", "7.5"] * 20
    cells = zip(
        column(79, 21), column(80, 20), column(81, 19), [None] * 100, ["12"] * 100,
        ["1.5", "2"] * 50, odd, strict=True,
    )
    df = safe_coerce(rows(", ".join(f"{n} string" for n in names), *cells))
    kinds = dict(df.dtypes)
    assert kinds == {
        "p79": "string", "p80": "bigint", "p81": "bigint", "empty": "string", "iso3": "string",
        "real": "double", "odd": "string",
    }
    assert df.where("p80 is null").count() == 20 and df.first()["p80"] == 1000
    loose = safe_coerce(df.select("odd"), 0.4)
    assert dict(loose.dtypes) == {"odd": "double"} and loose.where("odd > 0").count() == 40


def test_coerce_without_rows(rows):
    df = rows("a string, b int")
    assert safe_coerce(df).schema == df.schema


def test_tables(spark, rows):
    spark.sql("create database if not exists t1")
    write_table(rows("y int, v string", (1, "a"), (2, "b"), (1, "c")), "t1.x", partition_by=["y"])
    write_table(rows("y int, w long", (1, 5)), "t1.x")
    found, absent = read_tables(spark, ["x", "nope"], "t1")
    assert list(found) == ["x"] and absent == ["nope"]
    assert found["x"].columns == ["y", "w"]
    register_views(found)
    assert spark.sql("select sum(w) from x").first()[0] == 5


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
def test_a_crash_between_any_two_steps_leaves_the_old_or_the_new_table(spark, rows, monkeypatch, step):
    """The process dies before the statement number ``step`` of a replacement."""
    table = f"crashed.t{step}"
    spark.sql("create database if not exists crashed")
    write_table(rows("x int", (1,)), table)
    new, sql, seen = rows("x int, y string", (2, "b")), spark.sql, []

    def dying(text, *rest, **named):
        seen.append(text)
        if len(seen) == step + 1:
            raise Crash(text)
        return sql(text, *rest, **named)

    monkeypatch.setattr(type(spark), "sql", lambda _, *rest, **named: dying(*rest, **named))
    try:
        write_table(new, table)
        crashed = False
    except Crash:
        crashed = True
    monkeypatch.undo()
    assert crashed == (step < len(seen) and len(seen) == step + 1)
    got = [tuple(r) for r in spark.table(table).collect()]
    assert got in ([(1,)], [(2, "b")])
    if not crashed:
        assert got == [(2, "b")]
    shown = shown_version(spark, table)
    drop_old_versions(spark, table)
    left = [t.name for t in spark.catalog.listTables("crashed__versions") if t.name.startswith(f"t{step}__")]
    assert [f"crashed__versions.{name}" for name in left] == [shown]
    assert [tuple(r) for r in spark.table(table).collect()] == got
    write_table(rows("x int", (3,)), table)
    assert [tuple(r) for r in spark.table(table).collect()] == [(3,)]
    drop_table(spark, table)
    assert not spark.catalog.tableExists(table) and drop_old_versions(spark, table) == []


def test_versions_of_plain_quoted_and_empty_tables(spark, rows):
    spark.sql("create database if not exists plainly")
    rows("x int", (1,)).write.saveAsTable("plainly.t")
    assert shown_version(spark, "plainly.t") is None
    write_table(spark.table("plainly.t").selectExpr("x + 1 x", "'k' k"), "plainly.t", partition_by=["k"])
    assert [tuple(r) for r in spark.table("plainly.t").collect()] == [(2, "k")]
    assert "PartitionFilters: [isnotnull" in spark.table("plainly.t").where("k = 'k'")._jdf.queryExecution().toString()
    write_table(rows("`a b` int, `A.c` string"), "`plainly`.`t`")
    assert spark.table("plainly.t").columns == ["a b", "A.c"] and spark.table("plainly.t").count() == 0
    write_table(rows("x int", (1,), (1,), (None,)), "plainly.t__extra")
    assert drop_old_versions(spark, "plainly.t") == []
    assert spark.table("plainly.t__extra").count() == 3
    drop_table(spark, "plainly.nothing")


def test_settle_uses_the_shared_folder(spark, rows):
    df = settle(rows("a int", (1,), (2,)), "s")
    assert df.count() == 2
    assert shared_dir(spark) in df.inputFiles()[0]


FTS = """Country,Cluster code,Cluster,Year,Appeal,Appeal id,Required,Funded,Pct
#country+code,#sector+cluster+code,#sector+cluster+name,#date+year,#activity+appeal+name,#activity+appeal+id+fts_internal,#value+funding+required+usd,#value+funding+total+usd,#value+funding+pct
AFG,3, Health ,2023,A,1,12345678.5,6172839.25,50
AFG,3,Health,2023,B,2,100,-5,0
AFG,4,,2024,C,3,50,10,20
SYR,3,Health,2024,D,4,0,10,
SYR,9,WASH,FY24,E,5,10,10,100
SYR,9,WASH,2024,E,5,"1,000",10,1
"""  # noqa: E501
HNO = """Country,Sector,In need,Targeted,Population
#country+code,#sector+description,#inneed,#targeted,#population
AFG,Santé,"1,000",500,9000
AFG,WASH,200,100,x
"""
POP = "ISO3,Population,Reference_year\nAFG,40000,2020\nAFG,2000,2021\nSYR,0,2020\n"
PROJECTS = (
    "PooledFundName,ChfProjectCode,OrganizationName,OrganizationType,ProjectTitle,AllocationYear,"
    "AllocationType,Budget,ProjectStatus,Cluster,ClusterPercentage,AdminLocation1,"
    "AdminLocation1Latitude,AdminLocation1Longitude,GenderMarker,EnvironmentMarker,"
    "ActualStartDate,ActualEndDate\n"
    "AFG,P1,Org,NGO,T,2023,Std,100.5,Open,Health,100,Kabul,34.5,69.2,2a,A,01/01/2023,01/06/2023\n"
    "AFG,,Org,NGO,T,2023,Std,1,Open,Health,100,Kabul,,,2a,A,,\n"
)
GIFTS = (
    "PooledFundName,PooledFundId,FiscalYear,DonorName,CountryCode,PledgeAmt,PaidAmt\n"
    "AFG,1,2023,Norway,NO,100,50\nAFG,1,2023,Norway,NO,10,\nAFG,1,2023,Chile,CL,5,5\n"
)
EMDAT = (
    "ISO,Disaster Type,Disaster Subtype,Start Year,Total Deaths,Total Affected,"
    "Total Damage ('000 US$)\n"
    "AFG,Flood,Riverine,2022,10,1000000,5\nAFG,Drought,,2010,9,9,9\nAFG,Quake,,2023,,,\n"
)


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("files")
    files = {
        "fts_requirements": ing.Dataset(put(home, "f.csv", FTS, True), hxl=True),
        "hno": ing.Dataset(put(home, "h.csv", HNO), hxl=True, constants={"year": 2025}),
        "population": ing.Dataset(put(home, "p.csv", POP), hxl=True),
        "projects": ing.Dataset(put(home, "j.csv", PROJECTS)),
        "contributions": ing.Dataset(put(home, "c.csv", GIFTS)),
        "emdat": ing.Dataset(put(home, "e.csv", EMDAT), clean=punctuated_name),
        "missing": ing.Dataset(str(home / "none.csv")),
    }
    status = ing.ingest(spark, files, "pipe")
    return "pipe", {r["dataset"]: r for r in status.collect()}


def test_ingest_isolates_failures(spark, database):
    name, status = database
    assert status["missing"]["error"] and status["missing"]["rows"] is None
    assert status["fts_requirements"]["rows"] == 6 and status["hno"]["cols"] == 6
    assert spark.table(f"{name}.raw_hno").select("year").distinct().collect() == [(2025,)]
    frames, _ = read_tables(spark, ["raw_hno", "raw_emdat"], name)
    summary = {r["dataset"]: r["rows"] for r in ing.summarize(frames).collect()}
    assert summary == {"raw_hno": 2, "raw_emdat": 3}


def test_files_to_served_tables(spark, database):
    name, _ = database
    assert tables.build_tables(spark, name) == ["features", "projects", "contributions"]
    got = {(r["country_code"], r["cluster_name"], r["year"]): r for r in
           spark.table(f"{name}.features").collect()}
    assert set(got) == {("AFG", "health", 2023), ("AFG", None, 2024), ("SYR", "wash", 2024)}
    row = got["AFG", "health", 2023]
    assert row["total_requirements_usd"] == 12345778.5
    assert row["total_funding_usd"] == 6172839.25
    assert row["num_appeals"] == 2 and row["funding_pct"] == 25.0
    assert row["total_inneed"] == 1200 and row["total_targeted"] == 600
    assert row["hno_population"] == 9000 and row["total_population"] == 42000
    assert row["num_disasters_5yr"] == 2 and row["total_disaster_deaths_5yr"] == 10
    assert abs(row["disaster_severity_score"] - (0.8 + 0.0003 + 0.3)) < 1e-12
    assert row["targeting_coverage_rate"] == 0.5
    syr = got["SYR", "wash", 2024]
    assert syr["total_requirements_usd"] == 1000 and syr["requirement_per_capita"] is None
    assert syr["funding_per_capita"] is None and syr["hno_population"] is None
    assert syr["total_inneed"] == 0 and syr["targeting_coverage_rate"] is None
    assert len(spark.table(f"{name}.features").columns) == 29
    gifts = spark.table(f"{name}.contributions").first()
    assert tuple(gifts) == ("AFG", 2023, 115.0, 55.0, 2)
    projects = spark.table(f"{name}.projects")
    assert projects.count() == 1 and len(projects.columns) == 18
    assert projects.first()["budget"] == 100.5


def test_large_amounts_survive_coercion(spark, database):
    raw = spark.table(f"{database[0]}.raw_fts_requirements")
    assert dict(raw.dtypes)["value_funding_required_usd"] == "double"
    top = raw.agg(F.max("value_funding_required_usd")).first()[0]
    assert top == 12345678.5


def test_build_skips_what_has_no_source(spark):
    assert tables.build_tables(spark, "nothing_here") == []


def test_a_line_with_too_many_cells_fails(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("a,b\n1,2,3\n4,5\n")
    for column in ("a", "b"):
        with pytest.raises(Exception, match="more cells"):
            load_csv(spark, str(path)).select(column).collect()
    path.write_text("a,b\n1\n4,5\n")
    assert [tuple(r) for r in load_csv(spark, str(path)).collect()] == [("1", None), ("4", "5")]


@pytest.mark.parametrize("line", ["3,4,,9", "3,4,", "3,4,,", '3,"4,""x",5', "3,4,5,6,7,8"])
@pytest.mark.parametrize("multi_line", [None, False, True])
def test_no_cell_is_lost(spark, tmp_path, line, multi_line):
    path = put(tmp_path, "w.csv", f"a,b\n1,2\n{line}\n")
    df = load_csv(spark, path, multi_line=multi_line)
    for columns in (["a"], ["b"], ["a", "b"]):
        with pytest.raises(Exception, match="more cells"):
            df.select(*columns).collect()
    with pytest.raises(Exception, match="more cells"):
        df.count()
    hxl = put(tmp_path, "w2.csv", f"A,B\n#a,#b\n1,2\n{line}\n")
    with pytest.raises(Exception, match="more cells"):
        load_hxl(spark, hxl, multi_line=multi_line).collect()


def test_cells_with_commas_quotes_and_lines_are_one_cell(spark, tmp_path):
    path = put(tmp_path, "c.csv", 'a,b\n"1,2","x ""y"", z"\n3\n,\n"l1\nl2, ""q""",5\n4,it"s, \n')
    with pytest.raises(Exception, match="more cells"):
        load_csv(spark, path).collect()
    path = put(tmp_path, "d.csv", 'a,b\n"1,2","x ""y"", z"\n3\n,\n"l1\nl2, ""q""",5\n')
    assert [tuple(r) for r in load_csv(spark, path).collect()] == [("1,2", 'x "y", z'), ("3", None), (None, None), ('l1\nl2, "q"', "5")]


def test_an_odd_quote_slows_one_file_down(spark, tmp_path):
    home = tmp_path / "many files"
    home.mkdir()
    put(home, "1.csv", "a,b\n1,x\n2,y\n")
    put(home, "2.csv", 'a,b\n3,"two\nlines"\n')
    put(home, "3.csv", "a,b\n4,z\n")
    parts = parts_by_scan(spark, str(home))
    assert [(len(files), multi) for files, multi in parts] == [(2, False), (1, True)]
    got = sorted(tuple(r) for r in load_csv(spark, str(home)).collect())
    assert got == [("1", "x"), ("2", "y"), ("3", "two\nlines"), ("4", "z")]
    assert parts_by_scan(spark, f"{home}/1.csv") == [(f"{home}/1.csv", False)]
    assert parts_by_scan(spark, f"{home}/2.csv") == [(f"{home}/2.csv", True)]


def test_ingest_refuses_a_file_with_a_surplus_cell_and_loads_a_tagged_one(spark, tmp_path):
    bad = put(tmp_path, "bad.csv", "a,b\n1,2\n3,4,,9\n")
    tagged = put(tmp_path, "tagged.csv", 'Country,Need ($),Need,Date\n#country+code,#value+usd,#value+usd,#date .x\nAFG,"1,000",2,2024-01-01\nUKR,5,,2024-02-01\n', bom=True)
    status = ing.ingest(spark, {"bad": ing.Dataset(bad), "tagged": ing.Dataset(tagged, hxl=True, constants={"year": 2025})}, "surplus")
    got = {r["dataset"]: r for r in status.collect()}
    assert "more cells" in got["bad"]["error"] and (got["tagged"]["rows"], got["tagged"]["cols"]) == (2, 5)
    rows = spark.table("surplus.raw_tagged").orderBy("country_code").collect()
    assert rows[0].asDict() == {"country_code": "AFG", "value_usd": 1000, "value_usd_1": "2", "date_.x": "2024-01-01", "year": 2025}
    assert not spark.catalog.tableExists("surplus.raw_bad")


def test_long_whole_numbers_stay_exact(spark, rows):
    got = safe_coerce(rows("x string, y string", ("1234567890123456789", "1"), ("2", "99999999999999999999")))
    assert got.dtypes == [("x", "bigint"), ("y", "double")]
    assert sorted(r["x"] for r in got.collect()) == [2, 1234567890123456789]


def test_a_failed_overwrite_keeps_the_table(spark, rows):
    spark.sql("create database if not exists kept")
    write_table(rows("x int", (1,)), "kept.t")
    bad = rows("x string", ("a",)).selectExpr("cast(raise_error('no') as int) x")
    with pytest.raises(Exception, match="no"):
        write_table(bad, "kept.t")
    assert [r["x"] for r in spark.table("kept.t").collect()] == [1]
    write_table(spark.table("kept.t").selectExpr("x + 1 x"), "kept.t")  # reads what it replaces
    assert [r["x"] for r in spark.table("kept.t").collect()] == [2]
    assert [t.name for t in spark.catalog.listTables("kept") if not t.isTemporary] == ["t"]


def test_statistics_come_from_footers(spark, sf_dir):
    before = {key: spark.conf.get(key) for key in PUSHDOWN}
    totals = footer_totals(spark, f"{sf_dir}/lineitem.parquet")
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(l_orderkey), MIN(l_orderkey)" in plan
    assert totals.first()[0] == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert {key: spark.conf.get(key) for key in PUSHDOWN} == before


def test_statistics_of_gaps_names_nothing_and_nan(spark, rows, tmp_path):
    nan, schema = float("nan"), "`a b` int, x double, s string, v array<int>, l long"
    frames = {
        "gaps": rows(schema, (1, None, None, [1], 2**60), (None, -0.0, "", None, 3), (1, 2.5, "t", [], None)),
        "empty": rows(schema),
        "nulls": rows(schema, *[(None,) * 5] * 2),
        "nan": rows(schema, (1, nan, "t", None, 1), (4, 2.0, "t", None, 1), (4, -1.0, "t", None, 1)),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / name))
    found = file_statistics(spark, {name: str(tmp_path / name) for name in frames})
    got = {(r["dataset"], r["column"]): tuple(r)[2:] for r in found.collect()}
    assert len(got) == 4 * 4 and not [k for k in got if k[1] == "v"]
    assert got["gaps", "a b"] == (3, 2, 1.0, 1.0) and got["gaps", "x"] == (3, 2, 0.0, 2.5)
    assert got["gaps", "s"] == (3, 2, None, None) and got["gaps", "l"] == (3, 2, 3.0, float(2**60))
    assert {got["empty", c] for c in ("a b", "x", "s", "l")} == {(0, 0, None, None)}
    assert {got["nulls", c] for c in ("a b", "x", "s", "l")} == {(2, 0, None, None)}
    assert got["nan", "x"] == (3, 3, -1.0, 2.0) and got["nan", "a b"] == (3, 3, 1.0, 4.0)
