"""Reading the part files of the activity datasets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymap.functions.columns import record_count, sum_or_zero, total
from tallymap.functions.name_tables import ALIASES, INVALID_NAMES
from tallymap.functions.names import Aliases, normalize_by_value, normalize_region_name
from tallymap.sources.scratch import stage
from tallymap.spec import Fact, FactSet, FactSpec

DATE_FORMAT = "dd-MM-yyyy"

# Header line; a quote inside a quoted field is doubled.
CSV_FORMAT = {"header": True, "escape": '"'}

FILE, CORRUPT, PROBLEM = "__file", "__corrupt", "__problem"

# Texts read as a missing value in CSV files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _token_to_null(name: str) -> Column:
    return F.when(~F.col(name).isin(*NULL_TOKENS), F.col(name)).alias(name)


def _texts(spark: SparkSession, paths: Sequence[str], spec: FactSpec, multi_line: bool, **reading) -> DataFrame:
    """The fields of all part files as text, missing values as NULL, with the name of the file.

    Every column is read whatever a query asks for, so a row's field count is always checked.
    """
    names = spec.raw_schema().fieldNames()
    extra = [reading["columnNameOfCorruptRecord"]] if "columnNameOfCorruptRecord" in reading else []
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in [*names, *extra])).options(
        **CSV_FORMAT, enforceSchema=False, columnPruning=False, multiLine=multi_line, **reading
    ).csv(list(paths))
    return raw.select(*map(_token_to_null, names), *extra, F.col("_metadata.file_path").alias(FILE))


def parsed_date(text: Column, fmt: str = DATE_FORMAT) -> Column:
    """The date a text stands for, NULL for any other text."""
    if fmt != DATE_FORMAT:
        return F.try_to_date(text, fmt)
    # Put in the order that a cast reads without a pattern; a cast also takes a day that ends in a blank or a T.
    at = lambda place, n: F.substring(text, place, n)
    shaped = (F.length(text) == 10) & (at(3, 1) == "-") & (at(6, 1) == "-") & at(2, 1).between("0", "9")
    return F.when(shaped, F.concat(at(7, 4), F.lit("-"), at(4, 2), F.lit("-"), at(1, 2)).try_cast("date"))


def _values(spec: FactSpec, dated: bool) -> dict[str, Column]:
    """What each field holds; NULL for a missing one and for one that cannot be read."""
    found = {f.name: F.col(f.name).try_cast(f.dataType) for f in spec.raw_schema().fields}
    if dated:
        found[spec.date_col] = parsed_date(F.col(spec.date_col))
    return found


def _checked(spec: FactSpec, values: dict[str, Column], dated: bool) -> dict[str, Column]:
    """The fields that not every text is a value of."""
    plain = {f.name for f in spec.raw_schema().fields if f.dataType == T.StringType()}
    return {n: v for n, v in values.items() if n not in plain or (dated and n == spec.date_col)}


def _bad(values: dict[str, Column]) -> dict[str, Column]:
    return {n: F.col(n).isNotNull() & v.isNull() for n, v in values.items()}


def _refuse(df: DataFrame, values: dict[str, Column], source: Column) -> DataFrame:
    """The same rows; one with a text that stands for no value raises, whichever columns a query reads."""
    bad = _bad(values)
    said = F.concat(source, *(F.when(b, F.concat(F.lit(f" {n}="), F.col(n))).otherwise("") for n, b in bad.items()))
    wrong = F.raise_error(F.concat(F.lit("bad value in "), said)).cast("boolean")
    return df.where(F.when(reduce(or_, bad.values()), wrong).otherwise(True))


def _typed(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*[v.alias(n) for n, v in values.items()])


def scan_parts(
    spark: SparkSession, paths: Sequence[str], spec: FactSpec, multi_line: bool = False
) -> DataFrame:
    """All part files of one dataset as one scan with an explicit schema.

    A row with too many or too few fields raises, and so does a bad number, whichever columns a
    query reads.  ``multi_line`` allows line breaks in quoted fields; files are then not split.
    """
    return _scan(spark, paths, spec, multi_line, dated=False)


def _scan(spark: SparkSession, paths: Sequence[str], spec: FactSpec, multi_line: bool, dated: bool) -> DataFrame:
    values = _values(spec, dated)
    texts = _texts(spark, paths, spec, multi_line, mode="FAILFAST")
    return _typed(_refuse(texts, _checked(spec, values, dated), F.col(FILE)), values)


def parse_dates(
    df: DataFrame, column: str = "date", fmt: str = DATE_FORMAT, strict: bool = True
) -> DataFrame:
    """Text to date; with ``strict`` a bad value raises, whether or not the column is read afterwards,
    otherwise it becomes NULL."""
    value = parsed_date(F.col(column), fmt)
    return (_refuse(df, {column: value}, F.lit("a date")) if strict else df).withColumn(column, value)


def load_fact(
    spark: SparkSession,
    spec: FactSpec,
    paths: Sequence[str],
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict_names: bool = False,
) -> Fact:
    """Typed fact table: part files, dates parsed, names of the widest level cleaned.

    It is lazy, and a field that cannot be read ends whatever query meets its row; ``load_checked`` sets such
    rows aside instead.
    """
    rows = _scan(spark, paths, spec, multi_line=False, dated=True)
    return Fact(normalize_region_name(rows, spec.levels[0], aliases, invalid, strict_names), spec)


def load_facts(
    spark: SparkSession, specs: Sequence[FactSpec], paths: Sequence[Sequence[str]]
) -> FactSet:
    return FactSet(*(load_fact(spark, s, p) for s, p in zip(specs, paths, strict=True)))


@dataclass(frozen=True)
class CheckedLoad:
    """A dataset whose files were read once into a table in the shared folder.

    ``rejects`` has (file, problem, line): the fields that cannot be read (or ``field count``) and the row.
    """

    fact: Fact
    rejects: DataFrame
    rows: DataFrame

    def report(self) -> DataFrame:
        """(file, rows, rejected) of each part file that has rows."""
        return self.rows.groupBy("file").agg(
            F.count(F.lit(1)).alias("rows"), F.count(PROBLEM).alias("rejected")
        )


def load_checked(
    spark: SparkSession,
    spec: FactSpec,
    paths: Sequence[str],
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict_names: bool = False,
    multi_line: bool = False,
) -> CheckedLoad:
    """Reads every field of the part files in one pass and sets aside the rows that cannot be read.

    Good rows and rejects are one Parquet table, so later queries read neither text nor columns they do not
    need.  Names are cleaned once per distinct name and joined back.  A wrong header still raises: it makes all of a file's
    rows unreadable.  Runs when called.
    """
    values = _values(spec, dated=True)
    texts = _texts(
        spark, paths, spec, multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    bad = [F.when(b, F.lit(n)) for n, b in _bad(_checked(spec, values, dated=True)).items()]
    problem = F.when(F.col(CORRUPT).isNotNull(), "field count").otherwise(
        F.nullif(F.concat_ws(", ", *bad), F.lit(""))
    )
    line = F.coalesce(CORRUPT, F.to_csv(F.struct(*spec.raw_schema().fieldNames())))
    rows = stage(
        texts.select(
            *[v.alias(n) for n, v in values.items()],
            problem.alias(PROBLEM),
            F.when(problem.isNotNull(), line).alias("line"),
            F.col(FILE).alias("file"),
        ),
        f"load-{spec.name}",
    )
    good = rows.where(F.col(PROBLEM).isNull()).select(*values)
    rejects = rows.where(F.col(PROBLEM).isNotNull()).select("file", F.col(PROBLEM).alias("problem"), "line")
    named = normalize_by_value(good, spec.levels[0], aliases, invalid, strict_names)
    return CheckedLoad(Fact(named, spec), rejects, rows)


def load_summary(facts: FactSet) -> DataFrame:
    """Distinct states of each table and their sorted list (a few dozen names)."""
    wide = facts.demographic.spec.levels[0]
    parts = [
        f.df.select(F.lit(f.spec.name).alias("dataset"), F.col(wide).alias("name")).distinct()
        for f in facts.all()
    ]
    names = parts[0].union(parts[1]).union(parts[2])
    return names.groupBy("dataset").agg(
        F.count("name").alias("n_states"), F.sort_array(F.collect_list("name")).alias("states")
    )


def load_summary_rows(facts: FactSet) -> DataFrame:
    """(dataset, state, records, total): a row per name, however many names there are."""
    wide = facts.demographic.spec.levels[0]
    parts = [
        f.df.groupBy(F.col(wide).alias(wide)).agg(
            record_count(f.spec).alias("records"), sum_or_zero(total(f.spec.measures)).alias("total")
        ).select(F.lit(f.spec.name).alias("dataset"), wide, "records", "total")
        for f in facts.all()
    ]
    return parts[0].union(parts[1]).union(parts[2])


def dataset_catalog(facts: FactSet) -> DataFrame:
    """Record count and field list of each table."""
    rows = [
        f.df.agg(record_count(f.spec).alias("records")).select(
            F.lit(f.spec.name).alias("dataset"),
            "records",
            F.array(*[F.lit(c) for c in f.df.columns]).alias("fields"),
        )
        for f in facts.all()
    ]
    return rows[0].union(rows[1]).union(rows[2])
