"""Schema alignment: which column of a source plays which role.

Everything here is an expression over a header array, so it runs once per source, not per row.
Positions are 1-based; NULL means the source has no such column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.dates import parse_date
from tillwork.functions.numbers import parse_number
from tillwork.functions.text import strip
from tillwork.staging import attach
from tillwork.vocabulary import (
    DATE_ROLE_WORDS,
    FIELD_WORDS,
    FILE_FORMATS,
    GOODS_TYPES,
    GOODS_WORDS,
    ORDER_ROLE_NAMES,
    PRICE_ROLE_WORDS,
    QUANTITY_ROLE_WORDS,
    REQUIRED_FIELDS,
    SERVICE_TYPES,
    SERVICE_WORDS,
    TOTAL_ROLE_WORDS,
)

ROLES = ["date", "total", "quantity", "price", "order", "item"]
_FIELDS = list(FIELD_WORDS)


def normalise_header(header: Column) -> Column:
    return F.transform(header, lambda name: strip(F.lower(name)))


def _contains_any(name: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | name.contains(word)
    return found


def _first(names: Column, test) -> Column:
    """Position of the first name that passes ``test``; NULL if none does."""
    flags = F.transform(names, lambda name: F.coalesce(test(name), F.lit(False)))
    return F.nullif(F.array_position(flags, F.lit(True)).cast("int"), F.lit(0))


def _direct_fields(names: Column) -> Column:
    return F.struct(*[_first(names, lambda n, f=f: n == f).alias(f) for f in _FIELDS])


def _fields_by_words(names: Column, direct: Column) -> Column:
    """Left to right, each column takes the first standard field still free whose words it contains."""
    columns = F.transform(names, lambda name, i: F.struct(name.alias("name"), (i + 1).cast("int").alias("ix")))

    def take(taken: Column, column: Column) -> Column:
        is_direct = F.lit(False)
        for f in _FIELDS:
            is_direct = is_direct | F.coalesce(taken[f] == column["ix"], F.lit(False))
        blocked = is_direct | column["name"].isNull()
        chosen = []
        for f in _FIELDS:
            hit = ~blocked & taken[f].isNull() & _contains_any(column["name"], FIELD_WORDS[f])
            chosen.append(F.when(hit, column["ix"]).otherwise(taken[f]).alias(f))
            blocked = blocked | hit
        return F.struct(*chosen)

    return F.aggregate(columns, direct, take)


def _item_position(names: Column, business_type: Column) -> Column:
    goods = _first(names, lambda n: _contains_any(n, GOODS_WORDS))
    services = _first(names, lambda n: _contains_any(n, SERVICE_WORDS))
    either = _first(names, lambda n: _contains_any(n, GOODS_WORDS + SERVICE_WORDS))
    kind = F.lower(F.coalesce(F.nullif(business_type, F.lit("")), F.lit("retalho")))
    return (
        F.when(kind.isin(SERVICE_TYPES), F.coalesce(services, goods))
        .when(kind.isin(GOODS_TYPES), F.coalesce(goods, services))
        .otherwise(either)
    )


def detect_roles(df: DataFrame, names: str = "names", business_type: str = "business_type") -> DataFrame:
    """Role positions over lower-case column names (``date_ix``, ``total_ix``, ..., ``item_ix``)."""
    cols = F.col(names)
    with_total = df.withColumn("total_ix", _first(cols, lambda n: _contains_any(n, TOTAL_ROLE_WORDS)))
    # The total column is not a price candidate, or every row with a quantity above one would
    # fail the check of total against price times quantity.
    price = F.array_position(
        F.transform(
            cols,
            lambda name, i: F.coalesce(_contains_any(name, PRICE_ROLE_WORDS), F.lit(False))
            & ~(i + 1).cast("int").eqNullSafe(F.col("total_ix")),
        ),
        F.lit(True),
    )
    return with_total.withColumns({
        "date_ix": _first(cols, lambda n: _contains_any(n, DATE_ROLE_WORDS)),
        "quantity_ix": _first(cols, lambda n: _contains_any(n, QUANTITY_ROLE_WORDS)),
        "price_ix": F.nullif(price.cast("int"), F.lit(0)),
        "order_ix": _first(cols, lambda n: n.isin(ORDER_ROLE_NAMES)),
        "item_ix": _item_position(cols, F.col(business_type)),
    })


def map_headers(headers: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Map each source's header to standard fields and roles.

    ``headers`` has ``source_id``, ``header`` (NULL or blank names are dropped columns) and
    ``business_type``. The result adds ``names`` (lower case, standard names in place), the role
    positions and ``status`` (``ok`` or ``missing_columns``). ``override`` may give
    (``source_id``, ``date_ix``, ``total_ix``, ``quantity_ix``) to replace a wrong guess.
    """
    lowered = headers.withColumn("_lowered", F.transform(normalise_header(F.col("header")), lambda n: F.nullif(n, F.lit(""))))
    direct = lowered.withColumn("_direct", _direct_fields(F.col("_lowered")))
    complete = F.lit(True)
    for f in REQUIRED_FIELDS:
        complete = complete & F.col("_direct")[f].isNotNull()
    mapped = direct.withColumn(
        "_fields", F.when(complete, F.col("_direct")).otherwise(_fields_by_words(F.col("_lowered"), F.col("_direct")))
    )
    fields = F.col("_fields")

    def renamed(name: Column, i: Column) -> Column:
        standard = F.coalesce(*[F.when((i + 1).cast("int") == fields[f], F.lit(f)) for f in _FIELDS])
        return F.coalesce(standard, name)

    named = mapped.withColumn("names", F.transform(F.col("_lowered"), renamed))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), F.col("names"))
    named = named.withColumn("status", F.when(F.size(missing) == 0, "ok").otherwise("missing_columns"))
    mapping = detect_roles(named).drop("_lowered", "_direct", "_fields")
    if override is None:
        return mapping
    # A correction names its source; corrections are few next to the sources.
    fixes = override.select("source_id", *[F.col(f"{r}_ix").alias(f"_{r}") for r in ("date", "total", "quantity")])
    fixed = mapping.join(fixes, "source_id", "left")
    for r in ("date", "total", "quantity"):
        fixed = fixed.withColumn(f"{r}_ix", F.coalesce(f"_{r}", f"{r}_ix"))
    has_both = F.col("date_ix").isNotNull() & F.col("total_ix").isNotNull()
    fixed = fixed.withColumn("status", F.when(has_both, "ok").otherwise(F.col("status")))
    return fixed.drop("_date", "_total", "_quantity")


def live_headers(raw_cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the names of all-empty columns set to NULL, plus the row count.

    Rows are counted by which of their cells hold anything, map-side, so that a source of any size comes
    down to the few patterns that its rows have; columns are looked at in those only.
    """
    pattern = F.array_join(F.transform("cells", lambda cell: F.when(cell.isNull(), "0").otherwise("1")), "")
    patterns = raw_cells.groupBy("source_id", pattern.alias("pattern")).agg(F.count("*").alias("rows"))
    columns = patterns.select("source_id", "rows", F.posexplode(F.split("pattern", "")).alias("at", "held"))
    columns = columns.groupBy("source_id", "at").agg(F.max("held").alias("held"), F.sum("rows").alias("rows"))
    # Every row has a first place, so the most rows of a place are all of them.
    per_source = columns.groupBy("source_id").agg(
        F.max("rows").alias("rows"), F.collect_set(F.when(F.col("held") == "1", F.col("at"))).alias("live")
    )
    joined = sources.join(per_source, "source_id", "left")
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    header = F.transform("header", lambda name, i: F.when(F.array_contains("live", i), name))
    return joined.withColumns({"rows": rows, "header": header}).drop("live")


def to_sales(raw_cells: DataFrame, mapping: DataFrame, mapping_bytes: int | None = None) -> DataFrame:
    """Source rows to typed sales rows; numbers and dates are parsed once, from text.

    ``mapping_bytes`` is the size of a mapping that is staged already. Sources that say when they were uploaded
    pass ``uploaded_at`` on to their rows. Rows of sources whose mapping is not ``ok`` are left out: ``source_status`` lists those.
    """
    picks = mapping.filter("status = 'ok'").select(
        "source_id", "client_id", "business_type",
        F.get("names", F.col("order_ix") - 1).alias("order_name"),
        *[f"{r}_ix" for r in ROLES], *(known := [c for c in ("uploaded_at",) if c in mapping.columns]),
    )
    rows = attach(raw_cells, picks, ["source_id"], "inner", size=mapping_bytes)

    def cell(role: str) -> Column:
        return F.when(F.col(f"{role}_ix").isNotNull(), F.get("cells", F.col(f"{role}_ix") - 1))

    return rows.select(
        "client_id", "source_id", "row_ix", "business_type",
        parse_date(cell("date")).alias("sale_ts"),
        cell("item").alias("item"),
        parse_number(cell("quantity")).alias("quantity"),
        parse_number(cell("price")).alias("unit_price"),
        parse_number(cell("total")).alias("amount"),
        cell("order").alias("order_ref"),
        "order_name",
        F.forall("cells", lambda c: c.isNull()).alias("is_blank"),
        F.col("date_ix").isNotNull().alias("has_date"),
        F.col("total_ix").isNotNull().alias("has_total"),
        F.col("price_ix").isNotNull().alias("has_price"),
        F.col("quantity_ix").isNotNull().alias("has_qty"),
        F.col("item_ix").isNotNull().alias("has_item"),
        F.col("order_ix").isNotNull().alias("has_order"),
        *known,
    )


def source_status(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per listed source: ``ok``, ``empty``, ``unsupported_format`` or ``missing_columns``.

    A bad source becomes a status, never a failed job.
    """
    known = mapping.select("source_id", "rows", F.col("status").alias("mapped"))
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    status = (
        F.when(~F.col("format").isin(FILE_FORMATS), "unsupported_format")
        .when(rows == 0, "empty")
        .otherwise(F.coalesce("mapped", F.lit("missing_columns")))
    )
    joined = sources.join(known, "source_id", "left")
    return joined.select("source_id", "client_id", "format", rows.alias("rows"), status.alias("status"))
