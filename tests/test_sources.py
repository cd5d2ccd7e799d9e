import datetime

import pytest
from pyspark.sql import functions as F

from tallymap import BIOMETRIC, DEMOGRAPHIC, ENROLMENT, Fact
from tallymap.operators.filters import date_range
from tallymap.operators.rollup import daily_cube, daily_record_counts, daily_totals, rollup_by
from tallymap.sources import csv_parts, exports, scratch
from tallymap.sources.csv_parts import dataset_catalog, load_fact, load_facts, load_summary, scan_parts
from tallymap.sources.cube import open_cube, save_cube
from tests.frames import DEMO, fact, rows, series


def write(path, header, lines):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


HEADER = "date,state,district,pincode,demo_age_5_17,demo_age_17_"


def test_part_files_are_one_table(spark, tmp_path):
    parts = [
        write(tmp_path / "a.csv", HEADER, ["01-09-2025,ORISSA,Puri,752001,1,2", "02-09-2025,goa,NA,403001,NA,4"]),
        write(tmp_path / "b.csv", HEADER, ["03-09-2025,null,Pune,411001,5,6"]),
        write(tmp_path / "c.csv", HEADER, ['04-09-2025,"Jammu, x",Puri,752001,7,8']),
    ]
    loaded = load_fact(spark, DEMOGRAPHIC, parts)
    assert loaded.df.schema["date"].dataType.simpleString() == "date"
    assert rows(loaded.df, "date") == [
        (datetime.date(2025, 9, 1), "Odisha", "Puri", 752001, 1, 2),
        (datetime.date(2025, 9, 2), "Goa", None, 403001, None, 4),
        (datetime.date(2025, 9, 3), "Unknown", "Pune", 411001, 5, 6),
        (datetime.date(2025, 9, 4), "Jammu, X", "Puri", 752001, 7, 8),
    ]
    # Missing keys drop out of their own level only, missing measures count as zero.
    assert rows(rollup_by(loaded, ["district"]), "district") == [("Pune", 5, 6, 11), ("Puri", 8, 10, 18)]
    assert [r.total for r in rollup_by(loaded, ["state"]).orderBy("state").collect()] == [4, 15, 3, 11]


def test_wrong_header_and_bad_number_raise(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER.replace("pincode", "zip"), ["01-09-2025,x,y,1,1,2"])
    with pytest.raises(Exception):
        scan_parts(spark, [path], DEMOGRAPHIC).collect()
    path = write(tmp_path / "b.csv", HEADER, ["01-09-2025,x,y,1,one,2"])
    with pytest.raises(Exception):
        scan_parts(spark, [path], DEMOGRAPHIC).collect()


def test_dates_strict_and_lenient(spark):
    df = spark.createDataFrame([("01-09-2025",), ("1-9-2025",), ("31-02-2025",), (None,)], "date string")
    lenient = [r.date for r in csv_parts.parse_dates(df, strict=False).collect()]
    assert lenient == [datetime.date(2025, 9, 1), None, None, None]
    for bad in ("1-9-2025", "31-02-2025"):
        with pytest.raises(Exception):
            csv_parts.parse_dates(spark.createDataFrame([(bad,)], "date string")).collect()


def test_three_datasets_summary_and_catalog(spark, tmp_path):
    demo = write(tmp_path / "d.csv", HEADER, ["01-09-2025,goa,A,1,1,2", "01-09-2025,kerala,B,2,1,2"])
    bio = write(tmp_path / "b.csv", "date,state,district,pincode,bio_age_5_17,bio_age_17_", ["01-09-2025,goa,A,1,3,4"])
    enrol = write(
        tmp_path / "e.csv", "date,state,district,pincode,age_0_5,age_5_17,age_18_greater",
        ["01-09-2025,goa,A,1,1,1,1"],
    )
    facts = load_facts(spark, [DEMOGRAPHIC, BIOMETRIC, ENROLMENT], [[demo], [bio], [enrol]])
    summary = rows(load_summary(facts), "dataset")
    assert summary == [
        ("biometric", 1, ["Goa"]), ("demographic", 2, ["Goa", "Kerala"]), ("enrolment", 1, ["Goa"])
    ]
    catalog = {r.dataset: (r.records, list(r.fields)) for r in dataset_catalog(facts).collect()}
    assert catalog["demographic"] == (2, HEADER.split(","))
    assert catalog["enrolment"][0] == 1


def test_csv_export_reads_back_equal(spark, tmp_path):
    df = spark.createDataFrame([(" x ", 1, 0.1), ("a,b", 2, None), ('say "hi", ok', 3, 1e-9)], "name string, n int, v double")
    exports.write_csv(df, str(tmp_path / "out"))
    back = spark.read.schema(df.schema).options(**csv_parts.CSV_FORMAT).csv(str(tmp_path / "out"))
    assert rows(back, "n") == rows(df, "n")
    with pytest.raises(Exception):  # an existing folder is never overwritten
        exports.write_csv(df, str(tmp_path / "out"))


def test_cube_answers_like_the_rows(spark):
    d = datetime.date
    f = fact(spark, DEMO, [(d(2025, 1, 1), "A", "D", 1, 1, 2), (d(2025, 1, 1), "A", "D", 1, 3, 4),
                           (d(2025, 1, 2), None, "D", 1, 3, None)])
    cube = daily_cube(f)
    assert cube.df.count() == 2
    assert rows(daily_totals(cube), "date") == rows(daily_totals(f), "date")


def test_saved_cube_keeps_record_counts(spark, tmp_path):
    f = series(spark, list(range(50)))
    twice = f.on(f.df.union(f.df))
    save_cube(twice, str(tmp_path / "cube"))
    cube = open_cube(spark, DEMO, str(tmp_path / "cube"))
    assert cube.df.count() == 50
    assert rows(daily_record_counts(cube), "date") == rows(daily_record_counts(twice), "date")
    assert date_range(cube, 7).df.count() == 8


def test_stage_and_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert rows(scratch.stage(df), "id") == rows(df, "id")
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)


def test_measure_names_must_differ(spark):
    f = fact(spark, DEMO, [])
    from tallymap import FactSet

    with pytest.raises(ValueError):
        FactSet(f, Fact(f.df, DEMO), f)


@pytest.mark.parametrize("row", ["01-09-2025,Goa,North,403001,1,2,9", "01-09-2025,Goa"])
def test_rows_with_other_field_counts_raise(spark, tmp_path, row):
    (tmp_path / "part.csv").write_text(f"date,state,district,pincode,{','.join(DEMOGRAPHIC.measures)}\n01-09-2025,Goa,North,403001,1,2\n{row}\n")
    scan = scan_parts(spark, [str(tmp_path)], DEMOGRAPHIC)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        scan.groupBy("state").count().collect()


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "part.csv").write_text(f'date,state,district,pincode,{",".join(DEMOGRAPHIC.measures)}\n01-09-2025,Goa,"Nor\nth",403001,1,2\n')
    assert [r.district for r in scan_parts(spark, [str(tmp_path)], DEMOGRAPHIC, multi_line=True).collect()] == ["Nor\nth"]
