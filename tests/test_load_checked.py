import datetime

import pytest
from pyspark.sql import functions as F

from tallymap import DEMOGRAPHIC
from tallymap.functions.name_tables import ALIASES
from tallymap.functions.names import normalize_by_value, normalize_region_name
from tallymap.operators.rollup import daily_totals, rollup_by, rollup_named
from tallymap.sources.csv_parts import load_checked, load_fact, parse_dates, scan_parts
from tests.frames import DEMO, fact, rows

HEADER = "date,state,district,pincode,demo_age_5_17,demo_age_17_"
GOOD = "01-09-2025,goa,North,403001,1,2"
BAD = {
    "date": "31-02-2025,goa,North,403001,1,2",
    "pincode": "01-09-2025,goa,North,x7,1,2",
    "demo_age_17_": "01-09-2025,goa,North,403001,1,two",
    "date, demo_age_5_17": "2025-09-01,goa,North,403001,1.5,2",
}
COUNTS = ("01-09-2025,goa,North,403001,1,2,9", "01-09-2025,goa")


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize("line", [*BAD.values(), *COUNTS])
@pytest.mark.parametrize("ask", [lambda f: rollup_by(f, ["state"]), daily_totals, lambda f: f.df.groupBy().count()])
def test_bad_rows_raise_in_every_query(spark, tmp_path, line, ask):
    loaded = load_fact(spark, DEMOGRAPHIC, [write(tmp_path / "a.csv", GOOD, line)])
    with pytest.raises(Exception, match="bad value|MALFORMED|FAILED_READ_FILE"):
        ask(loaded).collect()


def test_the_error_names_file_field_and_text(spark, tmp_path):
    loaded = load_fact(spark, DEMOGRAPHIC, [write(tmp_path / "part7.csv", GOOD, BAD["date, demo_age_5_17"])])
    with pytest.raises(Exception, match=r"bad value in .*part7\.csv date=2025-09-01 demo_age_5_17=1\.5"):
        rollup_by(loaded, ["state"]).collect()


def test_strict_dates_raise_when_not_read(spark):
    frame = spark.createDataFrame([("31-02-2025", 1), ("01-02-2025", 2)], "date string, n int")
    with pytest.raises(Exception, match="date=31-02-2025"):
        parse_dates(frame).agg(F.sum("n")).collect()
    assert parse_dates(frame, strict=False).agg(F.sum("n")).first()[0] == 3


@pytest.mark.parametrize("text", ["29-02-2024", "29-02-2023", "00-01-2020", "1-01-2020", "01-1-2020", "+1-01-2020", " 01-01-2020",
                                  "01/01/2020", "01-01-20", "01-13-2020", "01-01-2020x", "31-12-9999", "01-01-0001", ""])
def test_dates_read_as_the_pattern_says(spark, text):
    frame = spark.createDataFrame([(text,)], "date string")
    want = frame.select(F.try_to_date("date", "dd-MM-yyyy")).first()[0]
    assert parse_dates(frame, strict=False).first()[0] == want


def test_rejects_are_kept_with_reason_and_file(spark, tmp_path):
    paths = [
        write(tmp_path / "a.csv", GOOD, *BAD.values(), "02-09-2025,kerala,NA,,NA,4"),
        write(tmp_path / "b.csv", *COUNTS, "03-09-2025,null,Pune,411001,5,6", '04-09-2025,"Jammu, x",Puri,x,7,8'),
        write(tmp_path / "c.csv"),
    ]
    load = load_checked(spark, DEMOGRAPHIC, paths)
    assert rows(load.fact.df, "date") == [
        (datetime.date(2025, 9, 1), "Goa", "North", 403001, 1, 2),
        (datetime.date(2025, 9, 2), "Kerala", None, None, None, 4),
        (datetime.date(2025, 9, 3), "Unknown", "Pune", 411001, 5, 6),
    ]
    assert load.fact.df.columns == HEADER.split(",")
    got = sorted((r.file.rsplit("/", 1)[1], r.problem, r.line) for r in load.rejects.collect())
    assert got == sorted(
        [("a.csv", k, v) for k, v in BAD.items()]
        + [("b.csv", "field count", line) for line in COUNTS]
        + [("b.csv", "pincode", '04-09-2025,"Jammu, x",Puri,x,7,8')]
    )
    report = {r.file.rsplit("/", 1)[1]: (r.rows, r.rejected) for r in load.report().collect()}
    assert report == {"a.csv": (6, 4), "b.csv": (4, 3)}


def test_nothing_good_and_nothing_at_all(spark, tmp_path):
    load = load_checked(spark, DEMOGRAPHIC, [write(tmp_path / "a.csv", *BAD.values())])
    assert load.fact.df.count() == 0 and load.rejects.count() == len(BAD)
    load = load_checked(spark, DEMOGRAPHIC, [write(tmp_path / "b.csv")])
    assert (load.fact.df.count(), load.rejects.count(), load.report().count()) == (0, 0, 0)


def test_wrong_header_raises(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER.replace("pincode", "zip") + "\n" + GOOD + "\n")
    with pytest.raises(Exception):
        load_checked(spark, DEMOGRAPHIC, [str(path)])


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", '01-09-2025,goa,"No\nrth",403001,1,2', '01-09-2025,goa,"No\nrth",y,1,2')
    load = load_checked(spark, DEMOGRAPHIC, [path], multi_line=True)
    assert [r.district for r in load.fact.df.collect()] == ["No\nrth"]
    assert [r.problem for r in load.rejects.collect()] == ["pincode"]


def test_files_are_read_once_and_only_wanted_columns_after(spark, tmp_path):
    load = load_checked(spark, DEMOGRAPHIC, [write(tmp_path / "a.csv", GOOD)])
    plan = daily_totals(load.fact)._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower()
    assert "district" not in plan.split("ReadSchema")[1].split("\n")[0]


NAMES = [
    None, "", "   ", "Goa", "goa", " GOA\t", "Goalpara", "Oa", "pradesh", "x", "a", "123", "१२", "Jaipur", "West\nBengal", "goa\ngujarat",
    "o'neil x", "Daman & Diu", "Zürich", "İstanbul", "delhi ncr and kerala", "tamil", "nadu x", "z" * 300,
]


@pytest.mark.parametrize("strict", [False, True])
def test_names_by_value(spark, strict):
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES * 3)], "i int, state string")
    one = rows(normalize_region_name(frame, strict=strict), "i")
    assert rows(normalize_by_value(frame, strict=strict).select("i", "state"), "i") == one


def test_the_first_alias_in_table_order_wins(spark):
    keys = ["xx", "a", "e", "pradesh", "goa and assam", "assam goa", "du", "\n", "nagar haveli", "andhra pradesh telangana"]
    want = {}
    for k in keys:
        first = [o for a, o in ALIASES if a in k.strip() or k.strip() in a]
        want[k] = first[0] if first else k.strip().title()
    frame = spark.createDataFrame([(k, k) for k in keys], "k string, state string")
    assert {r.k: r.state for r in normalize_region_name(frame).collect()} == want


def test_folded_rollup_equals_rows(spark):
    d = datetime.date(2025, 1, 1)
    f = fact(spark, DEMO, [(d, n, f"D{i % 3}" if i % 5 else None, i % 4, i, 2 * i) for i, n in enumerate(NAMES * 4)])
    cleaned = f.on(normalize_region_name(f.df))
    for keys in (["state"], ["state", "district"], ["district"], ["date", "state"]):
        assert rows(rollup_named(f, keys), *keys) == rows(rollup_by(cleaned, keys), *keys)
