"""Tables already extracted from the pages of a document, as arrays of text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.staging import attach


def read_page_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of each source's tables by column name, as (sources, raw cells).

    ``tables`` has ``source_id``, ``client_id``, ``page``, ``table_ix`` and ``cells``
    (``array<array<string>>``, first row is the header). Tables of fewer than two rows are
    skipped; a header cell that is NULL or empty is named after its position.
    """
    whole = tables.filter(F.size("cells") >= 2)
    header = F.transform(
        F.get("cells", F.lit(0)),
        lambda name, i: F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("coluna_"), i.cast("string"))),
    )
    whole = whole.withColumn("header", header)

    # Distinct names per source in order of first appearance; grouped by name first, so a source
    # with very many tables never gathers their headers in one place.
    names = whole.select("source_id", "client_id", "page", "table_ix", F.posexplode("header").alias("position", "name"))
    first_seen = names.groupBy("source_id", "client_id", "name").agg(F.min(F.struct("page", "table_ix", "position")).alias("seen"))
    unions = first_seen.groupBy("source_id", "client_id").agg(
        F.array_sort(F.collect_list(F.struct("seen", "name")))["name"].alias("header")
    )
    listed = tables.groupBy("source_id", "client_id").agg(F.count("*").alias("_tables")).drop("_tables")
    sources = listed.join(unions, ["source_id", "client_id"], "left").withColumn("format", F.lit("pdf"))

    # Where each table keeps the columns of the union: worked out per table, not per row.
    placed = attach(whole.withColumnRenamed("header", "own_header"), unions.select("source_id", "header"), ["source_id"], "inner")
    positions = F.transform("header", lambda name: F.nullif(F.array_position("own_header", name), F.lit(0)).cast("int") - 1)
    rows = placed.select(
        "source_id", positions.alias("positions"), F.explode(F.slice("cells", 2, F.size("cells"))).alias("row")
    )
    cells = F.transform("positions", lambda p: F.get("row", p))
    raw = rows.select("source_id", F.monotonically_increasing_id().alias("row_ix"), cells.alias("cells"))
    return sources.select("source_id", "client_id", "format", "header"), raw
