"""Point lookups and filters over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("path", "line", "id")


def by_name(symbols: DataFrame, name: str, language: str | None = None) -> DataFrame:
    """Case-sensitive equality on the whole name, in path order."""
    found = symbols.where(F.col("name") == name)
    return (found.where(F.col("language") == language) if language else found).orderBy(*ORDER)


def page(found: DataFrame, limit: int, offset: int, order: tuple = ORDER) -> DataFrame:
    """One page of rows with `total`, the number of all; state is bounded by offset + limit."""
    if not 1 <= limit <= 1000 or not 0 <= offset <= 100_000:
        raise ValueError("limit is 1 to 1000, offset at most 100000")
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(*order).limit(offset + limit)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > offset)
    return rows.crossJoin(F.broadcast(total))  # one row; a page past the end is empty, `page_total` tells the number


def page_total(found: DataFrame, limit: int, offset: int) -> DataFrame:
    """(total, next_offset) of a page: next_offset is null on the last one and past the end."""
    after = offset + limit
    total = found.agg(F.count("*").alias("total"))
    return total.select("total", F.when(F.col("total") > after, F.lit(after)).cast("long").alias("next_offset"))


def dotted(symbols: DataFrame, path: str) -> DataFrame:
    """`owner.member`: symbols named member whose module ends with owner; none without a dot."""
    owner, _, member = path.rpartition(".")
    if not owner:
        return symbols.limit(0)
    return symbols.where((F.col("name") == member) & ((F.col("module") == owner) | F.col("module").endswith("." + owner)))


def id_or_name(symbols: DataFrame, target: str) -> DataFrame:
    """`symbol_id:N` or a name, with `status`: found or ambiguous; no rows if there is none."""
    if target.startswith("symbol_id:"):
        number = target[len("symbol_id:") :]
        if not number.isdigit() or number == "":
            raise ValueError(f"no symbol id: {target}")
        found = symbols.where(F.col("id") == int(number))
    else:
        found = symbols.where(F.col("name") == target)
    # rows that share one name, not the whole table
    n = found.agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(n)).withColumn("status", F.when(F.col("n") == 1, "found").otherwise("ambiguous")).drop("n")


def inventory(symbols: DataFrame, in_scope: Column, limit: int) -> DataFrame:
    """All symbols in scope; more than `limit` is an error, never a part."""
    found = symbols.where(in_scope)
    if found.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} symbols")
    return found.orderBy(*ORDER)


def facets(symbols: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Every facet must match, whatever the case; a missing value never matches."""
    for facet, value in wanted.items():
        symbols = symbols.where(F.lower(F.col(facet)) == value.lower())
    return symbols


def facet_rows(symbols: DataFrame) -> DataFrame:
    """(id, facet, value) of kind, visibility and language."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("kind", "visibility", "language")]))
    return symbols.select("id", pairs.alias("x")).select("id", "x.facet", "x.value").where("value is not null")


def visible_from(symbols: DataFrame, path: str, module: str) -> DataFrame:
    """Same file, or a module that is the other's prefix by whole segments, or public."""
    m = F.col("module")
    inside = (m == module) | m.startswith(module + ".") | F.lit(module).startswith(F.concat(m, F.lit(".")))
    return symbols.where((F.col("path") == path) | inside | (F.col("visibility") == "Public"))


def contains_position(ranges: DataFrame, line: int, column: int = 0) -> DataFrame:
    """Ranges (start_line, start_column, end_line, end_column) around a place, ends included."""
    at = F.struct(F.lit(line).alias("l"), F.lit(column).alias("c"))
    begin, end = (F.struct(F.col(f"{x}_line").cast("int").alias("l"), F.col(f"{x}_column").cast("int").alias("c")) for x in ("start", "end"))
    return ranges.where((begin <= at) & (at <= end))
