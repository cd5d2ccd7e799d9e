"""What an activity table looks like.

A fact table holds dated counts: one date column, a geography hierarchy stored
as plain columns (widest level first) and one integer column per age band or
other category.  Operators take a :class:`Fact` (frame + description) or a
:class:`FactSet` (the three related tables) and return lazy DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FactSpec:
    name: str
    measures: tuple[str, ...]
    date_col: str = "date"
    levels: tuple[str, ...] = ("state", "district", "pincode")
    # Set on pre-aggregated cubes: the column holding how many source rows a row stands for.
    records_col: str | None = None
    # Set on tables in monthly folders: the folder's column, the first day of the month.
    month_col: str | None = None

    def raw_schema(self) -> T.StructType:
        """Schema of the CSV files: the date is still text, the last level is a number."""
        geography = [T.StructField(c, T.StringType()) for c in self.levels[:-1]]
        return T.StructType(
            [T.StructField(self.date_col, T.StringType()), *geography]
            + [T.StructField(self.levels[-1], T.LongType())]
            + [T.StructField(m, T.LongType()) for m in self.measures]
        )


@dataclass(frozen=True)
class Fact:
    df: DataFrame
    spec: FactSpec

    def on(self, df: DataFrame) -> Fact:
        return replace(self, df=df)


@dataclass(frozen=True)
class FactSet:
    """The three related tables: same date column and levels, different measure names."""

    demographic: Fact
    biometric: Fact
    enrolment: Fact

    def __post_init__(self) -> None:
        names = [m for f in self.all() for m in f.spec.measures]
        if len(names) != len(set(names)):
            raise ValueError(f"measure names clash between the tables: {sorted(names)}")
        if len({(f.spec.date_col, f.spec.levels) for f in self.all()}) > 1:
            raise ValueError("the tables must share the date column and the levels")

    def all(self) -> tuple[Fact, Fact, Fact]:
        return (self.demographic, self.biometric, self.enrolment)

    def map(self, fn) -> FactSet:
        return FactSet(*(fn(f) for f in self.all()))


# Column names of the three CSV datasets (fixed values).
DEMOGRAPHIC = FactSpec("demographic", ("demo_age_5_17", "demo_age_17_"))
BIOMETRIC = FactSpec("biometric", ("bio_age_5_17", "bio_age_17_"))
ENROLMENT = FactSpec("enrolment", ("age_0_5", "age_5_17", "age_18_greater"))


@dataclass(frozen=True)
class CostParams:
    """Rates of the capacity and cost model (fixed values)."""

    per_staff_per_day: int = 150
    per_center_per_day: int = 200
    staff_monthly: int = 25_000
    rent: int = 50_000
    utilities: int = 15_000
    internet: int = 5_000
    maintenance: int = 10_000
    supplies: int = 8_000
    days_per_month: int = 30
    revenue_per_item: int = 100
    saving_rate: float = 0.02

    @property
    def fixed_monthly(self) -> int:
        return self.rent + self.utilities + self.internet + self.maintenance + self.supplies
