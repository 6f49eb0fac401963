"""Checks of output objects against their configuration, and of canonical records against the model."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.plans.projection import ProjectionConfig, compile_projection

#: Declared types and the Python types that satisfy them; others are not checked (fixed values).
TYPES: dict[str, tuple[type, ...]] = {"string": (str,), "array": (list,), "object": (dict,), "number": (int, float), "boolean": (bool,)}


class ProjectedValidationError(ValueError):
    def __init__(self, errors: list[str]):
        self.errors = list(errors)
        super().__init__("; ".join(self.errors) or "projected record is invalid")


def expected_schema(config: ProjectionConfig) -> list[tuple[str, tuple[type, ...] | None, bool, str | None]]:
    """(path, accepted types or None, required, declared type) of each field."""
    return [(s.path, TYPES.get(s.type or ""), s.required, s.type) for s in config.fields]


def validate_projected(record: Any, config: ProjectionConfig) -> list[str]:
    """Errors of one output object: required values that are null or absent, and values of another type than declared."""
    if not isinstance(record, dict):
        return [f"projected record must be a dict, got {type(record).__name__}"]
    errors = []
    for path, kinds, required, declared in expected_schema(config):
        value: Any = record
        for part in filter(None, path.split(".")):
            value = value.get(part) if isinstance(value, dict) else None
        if config.include_confidence and isinstance(value, dict) and {"value", "confidence"} <= set(value):
            value = value["value"]
        if value is None:
            if required:
                errors.append(f"required field {path!r} is missing or null")
        elif kinds and not isinstance(value, kinds):
            errors.append(f"field {path!r}: expected {declared}, got {type(value).__name__}")
    return errors


def assert_valid_projected(record: Any, config: ProjectionConfig) -> None:
    if errors := validate_projected(record, config):
        raise ProjectedValidationError(errors)


def _python_name(kind: T.DataType) -> str:
    names = {T.StringType: "str", T.ArrayType: "list", T.StructType: "dict", T.DoubleType: "float", T.IntegerType: "int", T.LongType: "int", T.BooleanType: "bool"}
    return names.get(type(kind), "str")


def projection_errors(canonical: DataFrame, config: ProjectionConfig) -> DataFrame:
    """``candidate_id, component, errors`` of every record, without bringing objects to the driver: types are checked on the plan, nulls on the rows."""
    compiled = compile_projection(canonical.schema, config)
    errors: list[Column] = []
    for spec, value, resolved, kind in zip(config.fields, compiled.values, compiled.resolved, compiled.kinds, strict=True):
        wrapped = config.include_confidence and isinstance(kind, T.StructType) and kind.names == ["value", "confidence"]
        inner, inner_kind = (value["value"], kind["value"].dataType) if wrapped else (value, kind)
        missing = F.lit(True) if resolved is None else ~F.coalesce(resolved, F.lit(False)) | inner.isNull()
        if spec.required:
            errors.append(F.when(missing, F.lit(f"required field {spec.path!r} is missing or null")))
        name = _python_name(inner_kind)
        accepted = {t.__name__ for t in TYPES.get(spec.type or "", ())} | ({"bool"} if spec.type == "number" else set())
        if resolved is not None and spec.type in TYPES and name not in accepted:
            errors.append(F.when(~missing, F.lit(f"field {spec.path!r}: expected {spec.type}, got {name}")))
    return canonical.select(F.col("candidate_id.value").alias("candidate_id"), "component", F.array_compact(F.array(*errors)).cast("array<string>").alias("errors"))


def canonical_errors(canonical: DataFrame) -> DataFrame:
    """``candidate_id, component, errors``: numbers that are no E.164, countries that are no two capitals, months that are no YYYY-MM, confidences and years out of bounds."""

    def any_of(array: str, bad, message: str) -> Column:
        return F.when(F.exists(array, bad), F.lit(message))

    off = lambda c: c.isNotNull() & ((c < 0) | (c > 1) | F.isnan(c))
    month = r"^\d{4}-\d{2}$"
    tests = [
        any_of("phones", lambda p: ~p["value"].rlike(r"^\+[1-9]\d{6,14}$"), "phones: not E.164"),
        F.when(~F.col("location.country.value").rlike("^[A-Z]{2}$"), F.lit("location.country: not ISO 3166 alpha-2")),
        any_of("experience", lambda e: ~F.coalesce(e["start"].rlike(month), F.lit(True)) | ~F.coalesce(e["end"].rlike(month), F.lit(True)), "experience: not YYYY-MM"),
        any_of("education", lambda e: F.coalesce(~e["end_year"].between(1900, 2100), F.lit(False)), "education.end_year: not in 1900..2100"),
        F.when(off(F.col("overall_confidence")), F.lit("overall_confidence: not in 0..1")),
        any_of("skills", lambda s: off(s["confidence"]), "skills.confidence: not in 0..1"),
        *[any_of(a, lambda x: off(x["confidence"]), f"{a}.confidence: not in 0..1") for a in ("emails", "phones")],
        *[F.when(off(F.col(f"{c}.confidence")), F.lit(f"{c}.confidence: not in 0..1")) for c in ("candidate_id", "full_name", "headline", "years_experience")],
    ]
    return canonical.select(F.col("candidate_id.value").alias("candidate_id"), "component", F.array_compact(F.array(*tests)).alias("errors"))
