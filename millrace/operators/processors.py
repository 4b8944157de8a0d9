"""Item processors and classifiers as projections and predicates.

A processor is a function from DataFrame to DataFrame whose parts are Columns,
so Catalyst pushes its predicates to the scan and collapses its projections.
Python callables are a fallback that runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Processor = Callable[[DataFrame], DataFrame]


def pass_through() -> Processor:
    return lambda df: df


def mapping(**columns: Column | str) -> Processor:
    """A projection: name = column or SQL expression."""
    return lambda df: df.select(*((F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def filtering(predicate: Column | str) -> Processor:
    """Keep rows whose predicate is true; null counts as false."""
    return lambda df: df.where(F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False)))


def composite(*processors: Processor) -> Processor:
    """One after the other; at least one."""
    if not processors:
        raise ValueError("a composite processor needs a delegate")
    return chain(*processors)


def chain(*processors: Processor) -> Processor:
    """One after the other; none is the identity."""

    def run(df: DataFrame) -> DataFrame:
        for p in processors:
            df = p(df)
        return df

    return run


def validating(valid: Column | str, keep_valid: bool = False, message: str = "the item is invalid") -> Processor:
    """Drop invalid rows if keep_valid, else fail at the first one that is read."""
    test = F.coalesce(F.expr(valid) if isinstance(valid, str) else valid, F.lit(False))
    if keep_valid:
        return lambda df: df.where(test)
    # the check stands in the filter, so that no projection can prune it
    return lambda df: df.where(F.when(test, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def violations(rules: dict[str, Column | str]) -> Column:
    """The messages of all rules that a row breaks; a rule that is null is broken."""
    found = [F.when(F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)), F.lit(None).cast("string")).otherwise(m) for m, c in rules.items()]
    return F.array_compact(F.array(*found)) if found else F.expr("cast(array() as array<string>)")


def bean_validating(rules: dict[str, Column | str], keep_valid: bool = False) -> Processor:
    """Drop rows that break a rule, or fail with all messages of the first such row."""
    found = violations(rules)
    if keep_valid:
        return lambda df: df.where(F.size(found) == 0)
    return lambda df: df.where(F.when(F.size(found) == 0, True).otherwise(F.raise_error(F.concat(F.lit("Validation failed: "), F.array_join(found, "; "))).cast("boolean")))


def script(function: Callable[[dict[str, Any]], dict[str, Any] | None], schema: StructType | str) -> Processor:
    """A callable per item, None to drop it, run on Arrow batches: for what no Column can say."""

    def run(df: DataFrame) -> DataFrame:
        target = df.sparkSession.createDataFrame([], schema).schema
        names = target.fieldNames()

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(target)
            for batch in source:
                out = [r for r in map(function, batch.to_pylist()) if r is not None]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)

        return df.mapInArrow(batches, target)

    return run


def concurrent(call: Callable[[dict[str, Any]], dict[str, Any] | None], schema: StructType | str, workers: int = 8) -> Processor:
    """A callable that waits for others (a service, a file), so many items at once in each task; None drops the item, order stays."""

    def run(df: DataFrame) -> DataFrame:
        target = df.sparkSession.createDataFrame([], schema).schema

        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from concurrent.futures import ThreadPoolExecutor

            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, names = to_arrow_schema(target), target.fieldNames()
            with ThreadPoolExecutor(workers) as pool:
                for batch in given:
                    out = [r for r in pool.map(call, batch.to_pylist()) if r is not None]
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)

        return df.mapInArrow(batches, target)

    return run


def adapter(target: Any, method: str, schema: StructType | str) -> Processor:
    return script(getattr(target, method), schema)


def rules_of(specification: dict[str, Sequence[str]]) -> dict[str, Column]:
    """A table of field rules (required, min:n, max:n, between:a,b, size:n, least_length:n, most_length:n, in:a|b, not_in:a|b, regex:p, numeric, integer, date, email, same:field) as named predicates."""
    made: dict[str, Column] = {}
    for field, rules in specification.items():
        value = F.col(field)
        for rule in rules:
            kind, _, argument = rule.partition(":")
            test = {
                "required": lambda v, a: v.isNotNull() & (F.trim(v.cast("string")) != ""),
                "min": lambda v, a: v.isNull() | (v >= float(a)),
                "max": lambda v, a: v.isNull() | (v <= float(a)),
                "in": lambda v, a: v.isNull() | v.cast("string").isin(*a.split("|")),
                "regex": lambda v, a: v.isNull() | v.cast("string").rlike(a),
                "between": lambda v, a: v.isNull() | v.between(*map(float, a.split(","))),
                "size": lambda v, a: v.isNull() | (F.char_length(v.cast("string")) == int(a)),
                "least_length": lambda v, a: v.isNull() | (F.char_length(v.cast("string")) >= int(a)),
                "most_length": lambda v, a: v.isNull() | (F.char_length(v.cast("string")) <= int(a)),
                "not_in": lambda v, a: v.isNull() | ~v.cast("string").isin(*a.split("|")),
                "integer": lambda v, a: v.isNull() | v.cast("string").try_cast("bigint").isNotNull(),
                "date": lambda v, a: v.isNull() | v.cast("string").try_cast("date").isNotNull(),
                "email": lambda v, a: v.isNull() | v.cast("string").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
                "same": lambda v, a: v.eqNullSafe(F.col(a)),
                "numeric": lambda v, a: v.isNull() | v.cast("string").try_cast("double").isNotNull(),
            }[kind](value, argument)
            made[f"{field}: {rule}"] = test
    return made


def classify(choices: Sequence[tuple[Column | str, Any]], default: Any = None) -> Column:
    """The value of the first predicate that is true, else the default."""
    out = F.lit(default)
    for predicate, value in reversed(choices):
        out = F.when(F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def lookup(key: Column, table: dict[str, Any], default: Any) -> Column:
    """The value of a routing key, else the default."""
    if not table:
        return F.lit(default)
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


@dataclass(frozen=True)
class SubclassClassifier:
    """The value of a class, or of its most specific base that is known."""

    table: dict[type, Any]
    default: Any = None

    def __call__(self, item: object) -> Any:
        kind = item if isinstance(item, type) else type(item)
        return next((self.table[k] for k in kind.__mro__ if k in self.table), self.default)


def binary_classifier(kinds: Sequence[type], default: bool = False) -> SubclassClassifier:
    return SubclassClassifier({k: not default for k in kinds}, default)
