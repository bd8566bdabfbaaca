"""Comma-separated records held as text: split by the quoting rules, load strictly, set the rest apart with reasons.

A field may be enclosed as a whole in double quotes; within, a quote is doubled and commas and line breaks are text.
All steps are built-in expressions, linear in the text: the record is split at its quotes, pieces at even positions lie
outside quotes and pieces at odd positions inside. An empty piece between two quoted ones is a doubled quote.

Defined results: a null record counts as empty (one field); repeated records give one result each; an empty table
gives no rows; columns of the input other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.text import strip_blanks, version_label

#: Stand-ins while a record is being split; their own occurrences in the text are escaped first.
_FIELD, _ESCAPE = "\u0001", "\u0002"


def _pieces(line: Column) -> Column:
    return F.split(F.coalesce(line, F.lit("")), '"', -1)


def _inner(pieces: Column) -> Column:
    """The pieces between the first and the last; those at odd positions (from 0) lie outside quotes."""
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))


def quoting_ok(line: Column) -> Column:
    """True if every quote of the record opens, closes or doubles as the rules allow."""
    pieces = _pieces(line)
    n, first, last = F.size(pieces), F.get(pieces, 0), F.element_at(pieces, -1)
    # outside quotes, a piece follows a closing quote with a comma and meets an opening quote with one; an empty one is a doubled quote
    bad = F.exists(F.transform(_inner(pieces), lambda x, i: (i % 2 == 1) & (x != "") & ~(x.startswith(",") & x.endswith(","))), lambda b: b)
    return (n == 1) | ((n % 2 == 1) & ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(",")) & ~bad)


def split_record(line: Column) -> Column:
    """The fields of a record whose quoting is right."""
    pieces = _pieces(line)

    def inside(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_FIELD), F.lit(_ESCAPE + "a"))

    def outside(x: Column) -> Column:
        return F.replace(inside(x), F.lit(","), F.lit(_FIELD))

    middle = F.transform(_inner(pieces), lambda x, i: F.when(i % 2 == 0, inside(x)).when(x == "", F.lit('"')).otherwise(outside(x)))
    joined = F.concat(outside(F.get(pieces, 0)), F.array_join(middle, ""), F.when(F.size(pieces) > 1, outside(F.element_at(pieces, -1))).otherwise(""))
    return F.transform(F.split(joined, _FIELD, -1), lambda x: F.replace(F.replace(x, F.lit(_ESCAPE + "a"), F.lit(_FIELD)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))


def rating_ok(c: Column) -> Column:
    """One to three digits 0-9 with a value up to 100, blanks at the ends aside."""
    return F.coalesce(strip_blanks(c).rlike(r"\A(?:[0-9]{1,2}|0[0-9]{2}|100)\z"), F.lit(False))


def label_ok(c: Column) -> Column:
    """A single letter A-F, blanks at the ends and a leading word "Version" aside."""
    return F.coalesce(version_label(c).rlike(r"\A[A-F]\z"), F.lit(False))


def _failed(fields: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in fields.items())))


def load_strict(raw: DataFrame, row_id: str, line: str, columns: list[str], checks: dict[str, object]) -> DataFrame:
    """The conforming records, as (row_id, *columns): right quoting, as many fields as `columns`, and every check holds.

    `checks` maps a column to a function from its text to a condition.
    """
    fields = raw.select(F.col(row_id).alias("row_id"), F.when(quoting_ok(F.col(line)), split_record(F.col(line))).alias("fields"))
    at = {c: i for i, c in enumerate(columns)}
    right = F.size("fields") == len(columns)
    for c, check in checks.items():
        right &= check(F.get(F.col("fields"), at[c]))
    return fields.where(F.coalesce(right, F.lit(False))).select("row_id", *(F.get(F.col("fields"), i).alias(c) for i, c in enumerate(columns)))


def rejects(raw: DataFrame, row_id: str, line: str, columns: list[str], checks: dict[str, object]) -> DataFrame:
    """(row_id, reason) of the records that `load_strict` leaves out: raw offsets less loaded offsets, then diagnosed."""
    loaded = load_strict(raw, row_id, line, columns, checks).select("row_id")
    rest = raw.select(F.col(row_id).alias("row_id"), F.col(line).alias("line")).join(loaded.withColumnRenamed("row_id", "loaded_id"), F.col("row_id").eqNullSafe(F.col("loaded_id")), "left_anti")
    at = {c: i for i, c in enumerate(columns)}
    fields = F.when(quoting_ok(F.col("line")), split_record(F.col("line")))
    reasons = (
        F.when(F.col("fields").isNull(), F.array(F.lit("quoting")))
        .when(F.size("fields") != len(columns), F.array(F.lit("column_count")))
        .otherwise(_failed({c: check(F.get(F.col("fields"), at[c])) for c, check in checks.items()}))
    )
    return rest.select("row_id", fields.alias("fields")).select("row_id", F.explode(reasons).alias("reason"))


def rejected_values(rows: DataFrame, row_id: str, checks: dict[str, object]) -> DataFrame:
    """(row_id, reason) of rows with a value that cannot be read: all offsets less those of conforming rows, then diagnosed."""
    values = rows.select(F.col(row_id).alias("row_id"), *checks)
    right = F.lit(True)
    for c, check in checks.items():
        right &= check(F.col(c))
    loaded = values.where(right).select(F.col("row_id").alias("loaded_id"))
    rest = values.join(loaded, F.col("row_id").eqNullSafe(F.col("loaded_id")), "left_anti")
    return rest.select("row_id", F.explode(_failed({c: check(F.col(c)) for c, check in checks.items()})).alias("reason"))
