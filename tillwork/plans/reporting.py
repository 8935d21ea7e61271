"""A reporting run: raw sources to cleaned sales to every client's report tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.operators import align, client_ops, kpis, periods, report, silver
from tillwork.sources.client_table import with_defaults
from tillwork.staging import attach, stage, stage_measured
from tillwork.vocabulary import DEFAULT_BUSINESS_TYPE


# What the key figures read of a cleaned sale.
FIGURE_COLUMNS = ["client_id", "business_type", "sale_ts", "item", "quantity", "amount", "order_ref", "has_item", "has_qty", "has_order"]


def ingest(sources: DataFrame, raw_cells: DataFrame, clients: DataFrame, override: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Align all sources: (sales, status per source)."""
    kinds = clients.select("client_id", "business_type")
    live = align.live_headers(raw_cells, sources).join(kinds, "client_id", "left").withColumn(
        "business_type", F.coalesce("business_type", F.lit(DEFAULT_BUSINESS_TYPE))
    )
    mapping, size = stage_measured(align.map_headers(live, override), "mapping")
    return align.to_sales(raw_cells, mapping, size), align.source_status(sources, mapping)


def key_figures(
    sales: DataFrame, clients: DataFrame, as_of: dt.date, period: str | None = None, daily: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(one row per client, ranked items) over cleaned sales of the period.

    The cleaned rows are staged once with their reason and period flag; every figure then reads
    only its own columns of that table.
    """
    return figures_of(silver.fill_fallbacks(silver.classify(sales), as_of), clients, as_of, period, daily)


def figures_of(
    classified: DataFrame, clients: DataFrame, as_of: dt.date, period: str | None = None, daily: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``key_figures`` of rows that have their ``reason``, or of a rollup of such rows."""
    counted = [c for c in ("rows",) if c in classified.columns]
    # Rows that only lack a date explain an empty result; they have no year.
    known = classified.filter("reason is null or reason = 'bad_date'").select(*FIGURE_COLUMNS, *counted, "reason", *[c for c in ("source_id",) if period is None])
    if period is None:
        known = periods.in_latest_year(known)
    else:
        known = known.withColumn("in_period", periods.between("sale_ts", *periods.period_range(period, as_of)))
    known = known.withColumn("in_period", F.col("reason").isNull() & F.col("in_period"))
    known = stage(known.select(*FIGURE_COLUMNS, *counted, "reason", "in_period"), "valid")
    valid = known.filter("reason is null").drop("reason")
    facts = kpis.source_facts(known, F.col("in_period"))
    in_period = valid.filter("in_period").drop("in_period")
    comparison = periods.today_and_yesterday(valid, as_of) if period == periods.TODAY else None
    rows = kpis.kpis(in_period, as_of, daily=daily or period == periods.TODAY, comparison=comparison)
    return kpis.complete(rows, facts, clients, as_of), kpis.top_items(in_period)


def report_tables(
    sales: DataFrame, clients: DataFrame, cadence: str, as_of: dt.date, uploads: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All report tables for the clients of one cadence; daily reports cover today only.

    Only each client's newest source counts, so that a sale sent again in a later file is not counted twice:
    by ``uploads`` (``client_id``, ``source_id``, ``uploaded_at``), or by the sales' own ``uploaded_at``. Sales
    that carry no such column are taken to be those of the newest source.
    """
    if uploads is None and "uploaded_at" in sales.columns:
        uploads = sales.groupBy("client_id", "source_id").agg(F.max("uploaded_at").alias("uploaded_at"))
    if uploads is not None:
        sales = client_ops.sales_of_latest_sources(sales, uploads)
    chosen, size = stage_measured(client_ops.of_cadence(clients, cadence), "clients")
    theirs = attach(sales, chosen.select("client_id"), ["client_id"], "left_semi", size=size)
    daily = cadence == report.DAILY
    rows, top = key_figures(theirs, chosen.select("client_id", "business_type"), as_of, periods.TODAY if daily else None, daily)
    rows, top = stage(rows, "kpis"), stage(top, "top")
    with_cadence = rows.withColumn("cadence", F.lit(cadence))
    tables = {
        "kpis": rows,
        "top_items": top,
        "kpi_block": report.kpi_block(rows),
        "top_table": report.top_table(top),
        "top_chart": report.top_chart(top),
        "insights": report.insights(rows, top),
        "summary_text": report.summary_text(with_cadence, as_of),
        "top_text": report.top_text(with_cadence, top),
    }
    if daily:
        tables["highlights"] = report.highlights(rows)
    return tables


def due_reports(
    sales: DataFrame, clients: DataFrame, run_ts: dt.datetime, uploads: DataFrame | None = None
) -> tuple[dict[str, dict[str, DataFrame]], DataFrame]:
    """(report tables by cadence, reminders) for the clients whose cadence fires at ``run_ts``.

    Registered clients with a file get a report, those without one a reminder. ``uploads`` as in ``report_tables``.
    """
    due = stage(client_ops.due(with_defaults(clients), run_ts), "due")
    filed = client_ops.with_file(due)
    reports = {}
    for cadence in (report.DAILY, report.WEEKLY, report.MONTHLY):
        if not client_ops.of_cadence(filed, cadence).isEmpty():
            reports[cadence] = report_tables(sales, filed, cadence, run_ts.date(), uploads)
    return reports, client_ops.reminders(due, filed)


def record_reports(clients: DataFrame, reported: DataFrame, location: str) -> DataFrame:
    """The client table with the report pointer of every reported client set to its new place."""
    updates = reported.select(
        "client_id", F.lit(location).alias("last_report"), F.array(F.lit("last_report")).alias("changed"), F.lit(0).alias("at")
    )
    return client_ops.update_fields(clients, updates, ["last_report"], ["at"])
