"""Regional activity analytics on Spark DataFrames."""

from tallymap.spec import BIOMETRIC, DEMOGRAPHIC, ENROLMENT, CostParams, Fact, FactSet, FactSpec

__all__ = ["BIOMETRIC", "DEMOGRAPHIC", "ENROLMENT", "CostParams", "Fact", "FactSet", "FactSpec"]
