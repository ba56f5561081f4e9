"""Dictionary source: lines of a header-less CSV as typed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(columns: Column, row_no: Column, wanted: int) -> Column:
    """The columns; a row with fewer than `wanted` ends the import, naming its line."""
    short = F.raise_error(F.concat(F.lit("line "), row_no.cast("string"), F.lit(" has "), F.size(columns).cast("string"), F.lit(f" columns, {wanted} are needed")))
    return F.when(F.size(columns) >= wanted, columns).otherwise(F.array(short.cast("string")))


def text_field(raw: Column, empty: str = "") -> Column:
    """Null for the empty string and for the value that stands for it."""
    return F.nullif(F.nullif(raw, F.lit("")), F.lit(empty))


def int_field(raw: Column) -> Column:
    """Figures without a sign as an int, 0 if there are none; anything else, and a number past an
    int, is an error."""
    wrong = F.raise_error(F.concat(F.lit("not a number: "), raw)).cast("int")
    return F.when(raw == "", 0).when(raw.rlike("^[0-9]+$"), F.coalesce(raw.try_cast("int"), wrong)).otherwise(wrong)


def quoted(separator: str) -> str:
    """A separator as a pattern that means just its characters."""
    return "".join(f"[{c}]" if c not in "^\\[]&" else f"\\{c}" for c in separator)


def list_field(raw: Column, separator: str = " ") -> Column:
    """Distinct values in order; the order of input doesn't count."""
    return F.array_sort(F.array_distinct(F.filter(F.split(raw, quoted(separator)), lambda x: x != "")))


def entries(lines: DataFrame, fields: dict[str, tuple[int, str]], row_no: str = "row_no", line: str = "line", empty: str = "") -> DataFrame:
    """(row_no, <fields>) of CSV lines (row_no, line). fields: name -> (column from 1, one of
    string, int, list). Quotes enclose values with separators in them."""
    most = max(at for at, _ in fields.values())
    # A mark after the last column tells columns that are missing from those that are empty.
    parsed = F.from_csv(F.concat(line, F.lit(",\x01")), F.lit(", ".join(f"c{k} string" for k in range(1, most + 1))), {"quote": '"', "escape": '"'})
    read = F.array(*[F.coalesce(parsed[f"c{k}"], F.lit("")) for k in range(1, most + 1)])
    end = F.array_position(read, "\x01").cast("int")
    cells = guarded(F.when(end > 0, F.slice(read, 1, F.greatest(end - 1, F.lit(0)))).otherwise(read), F.col(row_no), most)
    kinds = {"string": lambda c: text_field(c, empty), "int": int_field, "list": list_field}
    rows = lines.select(row_no, cells.alias("_cells"))
    return rows.select(row_no, *[kinds[kind](F.get("_cells", F.lit(at - 1))).alias(name) for name, (at, kind) in fields.items()])
