import pytest
from pyspark.sql import functions as F

from tallymap.functions.name_tables import ALIASES, INVALID_NAMES, UNKNOWN
from tallymap.functions.names import normalize_region_name, title_case

CASES = [
    (None, "Unknown"), ("", "Unknown"), ("100000", "Unknown"), ("560001", "Unknown"),
    ("Jaipur", "Unknown"), (" odisha ", "Odisha"), ("\tKerala\n", "Kerala"), ("ORISSA", "Odisha"),
    ("West Bangal", "West Bengal"), ("J&K", "Jammu & Kashmir"), ("new delhi", "Delhi"),
    ("Goalpara", "Goa"), ("Daman & Diu", "Dadra & Nagar Haveli and Daman & Diu"),
    ("Uttar", "Uttar Pradesh"), ("pradesh", "Andhra Pradesh"), ("   ", "Andhra Pradesh"),
    ("foo-bar", "Foo-Bar"), ("o'neil x", "O'Neil X"), ("zzz 9a", "Zzz 9A"),
    ("WEST  BENGAL", "West  Bengal"), ("Kerala", "Kerala"), (" Goa ", "Goa"),
]


def by_hand(raw):
    """The rules, stated for one value."""
    if raw is None or raw == "":
        return UNKNOWN
    key = raw.strip().lower()
    if key in INVALID_NAMES or key.isdigit():
        return UNKNOWN
    table = dict(ALIASES)
    if key in table:
        return table[key]
    near = [n for k, n in ALIASES if k in key or key in k]
    return near[0] if near else raw.strip().title()


def cleaned(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, state string")
    return [r.state for r in normalize_region_name(df, **options).orderBy("i").collect()]


def test_expected_names(spark):
    assert cleaned(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_all_aliases_and_fragments_follow_the_rules(spark):
    names = [k for k, _ in ALIASES] + [n for _, n in ALIASES] + list(INVALID_NAMES)
    variants = names + [n.upper() for n in names] + [f"  {n} x" for n in names] + [n[1:] for n in names]
    variants += [n[: len(n) // 2] for n in names] + ["émile-zola", "a1b2c3", "x's-y z", "٣٤"]
    assert cleaned(spark, variants) == [by_hand(v) for v in variants]


def test_strict_leaves_containment_out(spark):
    assert cleaned(spark, ["   ", "Goalpara", "ORISSA"], strict=True) == ["Unknown", "Goalpara", "Odisha"]


def test_other_tables_can_be_passed(spark):
    got = cleaned(spark, ["Bay", "bad", "Zed"], aliases=(("bay", "The Bay"),), invalid=("bad",))
    assert got == ["The Bay", "Unknown", "Zed"]


@pytest.mark.parametrize("text", ["foo-bar", "a1b", "o'neil", "ABC def", "", "9x-y"])
def test_title_case(spark, text):
    row = spark.range(1).select(title_case(F.lit(text)).alias("t")).first()
    assert row.t == text.title()
