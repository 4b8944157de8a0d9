"""Record formatting as column builders: tokenizers, extractors and line aggregators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, beyond U+0020 alone.
BLANKS = r"[\s   -     　\u0000]+"


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANKS}", ""), f"{BLANKS}$", "")


@dataclass(frozen=True)
class DelimitedTokenizer:
    """Quoted fields with doubled quotes, no escape character; missing fields become ''."""

    names: tuple[str, ...]
    delimiter: str = ","
    quote: str = '"'

    def __call__(self, line: Column) -> Column:
        schema = ", ".join(f"`{n}` string" for n in self.names)
        options = {"sep": self.delimiter, "quote": self.quote, "escape": self.quote, "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000"}
        fields = F.from_csv(line, F.lit(schema), options)
        return F.struct(*(F.coalesce(fields[n], F.lit("")).alias(n) for n in self.names))


@dataclass(frozen=True)
class FixedTokenizer:
    """Half-open, 0-based character ranges, each trimmed of Unicode white space."""

    ranges: tuple[tuple[int, int], ...]
    names: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.ranges or len(self.ranges) != len(self.names):
            raise ValueError("a fixed-width tokenizer needs a range for each of at least one name")

    def __call__(self, line: Column) -> Column:
        return F.struct(*(trim_unicode(F.substring(line, a + 1, b - a)).alias(n) for (a, b), n in zip(self.ranges, self.names, strict=True)))


@dataclass(frozen=True)
class PatternTokenizer:
    """The first pattern that a line matches chooses its tokenizer; a line that matches none is an error.

    All tokenizers give the same names, which the struct of the result has.
    """

    choices: tuple[tuple[str, DelimitedTokenizer | FixedTokenizer], ...]

    def __call__(self, line: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("no tokenizer matches the line: "), line))
        for pattern, tokenizer in reversed(self.choices):
            out = F.when(line.rlike(pattern), tokenizer(line)).otherwise(out)
        return out

    def choice(self, line: Column) -> Column:
        """The index of the matching pattern, null if none."""
        out = F.lit(None).cast("int")
        for i in range(len(self.choices) - 1, -1, -1):
            out = F.when(line.rlike(self.choices[i][0]), i).otherwise(out)
        return out


def as_text(value: Column) -> Column:
    """A value as text, null as ''."""
    return F.coalesce(value.cast("string"), F.lit(""))


def guard_formula(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote, and its own quotes doubled."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")))).otherwise(text)


def delimited_line(fields: Sequence[Column | str], delimiter: str = ",") -> Column:
    """Fields joined without quoting, each guarded; a null is ''."""
    return F.concat_ws(delimiter, *(guard_formula(as_text(F.col(c) if isinstance(c, str) else c)) for c in fields))


def formatted_line(pattern: str, fields: Sequence[Column | str]) -> Column:
    """printf over the fields in order."""
    return F.format_string(pattern, *fields)


def pass_through_line(value: Column) -> Column:
    return as_text(value)


def extract_fields(names: Sequence[str]) -> list[Column]:
    """Named fields of an item, in order; dots reach into structs."""
    return [F.col(n).alias(n.rpartition(".")[2]) for n in names]


def pass_through_fields(*columns: str) -> Column:
    return F.array(*(F.col(c).cast("string") for c in columns))


def field_at(values: Column, index: int) -> Column:
    """The field at an index from 0; an index that the record doesn't have is an error, not null."""
    if index < 0:
        raise ValueError(f"no field is at {index}")
    return F.when(F.size(values) > index, F.get(values, F.lit(index))).otherwise(F.raise_error(F.concat(F.lit(f"no field is at {index} of "), F.size(values).cast("string"))))


def field_named(names: Sequence[str], values: Column, name: str) -> Column:
    """The field of a name; an unknown name is an error at once."""
    if name not in names:
        raise ValueError(f"no field is named {name}")
    return field_at(values, list(names).index(name))


class LineTokenizer(Protocol):
    """A line to a struct of its fields."""

    def __call__(self, line: Column) -> Column: ...


class LineAggregator(Protocol):
    """A row's columns to a line."""

    def __call__(self, *fields: Column) -> Column: ...


class FieldMapper(Protocol):
    """Named fields to the columns of an item."""

    def __call__(self, fields: Column) -> dict[str, Column]: ...


def field_map(names: Sequence[str], values: Column) -> Column:
    """A map from names to an array's values, as many as there are names."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), values)


class LineMapper:
    """A tokenizer followed by a projection of its fields."""

    def __init__(self, tokenizer, mapping: dict[str, Column] | None = None):
        self.tokenizer, self.mapping = tokenizer, mapping

    def apply(self, df, line: str = "value"):
        tokens = df.withColumn("_tokens", self.tokenizer(F.col(line))).select("_tokens.*")
        return tokens if self.mapping is None else tokens.select(*(c.alias(n) for n, c in self.mapping.items()))
