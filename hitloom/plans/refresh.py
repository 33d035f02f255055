"""Ingest: changed raw files to the parsed table, then all aggregate tables of the affected dates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom import schema, session
from hitloom.config import SiteRules
from hitloom.operators import aggregates, enrich, search_join, sketches, suggestions
from hitloom.plans import periods
from hitloom.plans.dictionaries import Dictionaries
from hitloom.sources import storage
from hitloom.sources.versions import Store, Transaction

SEARCH_TABLES = {"gsc_daily": search_join.gsc_daily, "gsc_bot_daily": search_join.gsc_bot_daily}
ROLLUPS = {"traffic": aggregates.traffic_rollup, "pages": aggregates.page_rollup, "utm": aggregates.utm_rollup}

VALUES, GRAMS = (T.StructType([T.StructField(n, T.StringType()) for n in names]) for names in (("date", "field", "value"), ("date", "field", "gram", "value")))


class Warehouse:
    """The tables of one site in a versioned store: what an ingest changes becomes visible at its end, all at once."""

    def __init__(self, spark: SparkSession, root: str, rules: SiteRules, time_zone: str | None = None, clustered: bool = False):
        """``time_zone`` is that of the stored ``hourly`` table; UTC if not given. ``clustered`` sorts the requests of a
        file by path and writes Bloom filters, so that looking up one request opens one row group."""
        self.spark, self.root, self.rules, self.time_zone = session.tune(spark), root.rstrip("/"), rules, time_zone
        self.clustered = clustered
        self.store = Store(spark, self.root)
        self._change: Transaction | None = None

    @contextmanager
    def change(self) -> Iterator[Transaction]:
        """The running transaction, or a new one that is committed at the end unless something fails."""
        if self._change is not None:
            yield self._change
            return
        self._change = self.store.begin()
        try:
            yield self._change
            self._change.commit()
        finally:
            self._change = None

    # Tables -------------------------------------------------------------------------------------------

    def read(self, name: str, table_schema, dates=None) -> DataFrame:
        return (self._change or self.store).read(name, table_schema, dates)

    def parsed(self, dates=None) -> DataFrame:
        return self.read("parsed", schema.PARSED, dates)

    def search_perf(self, dates=None) -> DataFrame:
        return self.read("search_perf", schema.SEARCH_PERF, dates)

    def manifest(self) -> DataFrame:
        return self.read("files", schema.MANIFEST)

    def table(self, name: str, dates=None) -> DataFrame:
        return self.read(f"aggregates/{name}", self.schema_of(name), dates)

    def schema_of(self, name: str):
        """Schema of an aggregate table: that of its query over no rows."""
        none = self.spark.createDataFrame([], schema.PARSED)
        if name in SEARCH_TABLES:
            return SEARCH_TABLES[name](none, self.spark.createDataFrame([], schema.SEARCH_PERF)).schema
        return aggregates.TABLES[name](none).schema

    def unique_visitors(self, date_from: str | None = None, date_to: str | None = None, *keys: str) -> DataFrame:
        """Estimated distinct addresses of a range by ``url_group``, ``bot_family``, both or neither."""
        dates = [d for d in self.dates("parsed") if (date_from or d) <= d <= (date_to or d)]
        empty = sketches.visitor_sketches(self.spark.createDataFrame([], schema.PARSED))
        return sketches.unique_visitors(self.read("aggregates/visitor_sketches", empty.schema, dates), *keys)

    def suggest(self, field: str, text: str = "", limit: int = 10, dates=None) -> DataFrame:
        """Values of a field that contain a text, without reading requests."""
        values, grams = self.read("aggregates/field_values", VALUES, dates), self.read("aggregates/field_grams", GRAMS, dates)
        return suggestions.suggest(values, grams, field, text, limit)

    # Coverage: from the commit alone, no file of a table is listed or opened ---------------------------

    def dates(self, name: str = "parsed") -> list[str]:
        """The dates of a table: ``parsed``, ``search_perf``, ``files`` or an aggregate."""
        name = f"aggregates/{name}" if name in SEARCH_TABLES or name in aggregates.TABLES else name
        return (self._change.now if self._change else self.store.snapshot()).dates(name)

    def bounds(self, name: str = "parsed") -> tuple[str | None, str | None]:
        found = self.dates(name)
        return (found[0], found[-1]) if found else (None, None)

    def latest_ingested(self) -> str | None:
        """The latest date of which raw files were taken in."""
        return self.bounds("files")[1]

    def missing_search_dates(self) -> list[str]:
        """Dates that have requests and search data but lack one of the two search tables."""
        ready = set(self.dates("parsed")) & set(self.dates("search_perf"))
        return sorted(d for d in ready if any(d not in self.dates(n) for n in SEARCH_TABLES))

    def default_range(self, date_from: str | None = None, date_to: str | None = None) -> tuple[str | None, str | None]:
        """The given range, or the last 7 days with requests."""
        return periods.default_last_7(date_from, date_to, *self.bounds())

    def last_days(self, n: int) -> tuple[str | None, str | None]:
        last = self.bounds()[1]
        return periods.last_n(n, last) if last else (None, None)

    def comparison(self, date_from: str | None = None, date_to: str | None = None) -> tuple[str | None, ...]:
        """The current range and the one of the same length before it."""
        last = self.bounds()[1]
        return periods.compare(date_from, date_to, last) if last or (date_from and date_to) else (None,) * 4

    # Ingest -------------------------------------------------------------------------------------------

    def changed_dates(self, raw: str) -> list[str]:
        """Dates with new, changed or emptied raw files: what a dry run reports."""
        files = storage.list_raw(self.spark, raw)
        return [r.log_date for r in storage.affected_dates(files, self.manifest()).orderBy("log_date").collect()]

    def ingest(self, raw: str, dates: list[str] | None = None) -> list[str]:
        """Redo the affected dates (or the given ones) and record their files. Returns the dates."""
        dates = self.changed_dates(raw) if dates is None else sorted(dates)
        if not dates:
            return []
        with self.change() as change:
            files = storage.list_raw(self.spark, raw).where(F.col("log_date").isin(dates))
            change.write("files", storage.ingested_files(files), dates)
            self.load_parsed(storage.read_raw(self.spark, raw).where(F.col("date").isin(dates)), dates)
            self.refresh(dates)
        return dates

    def rebuild(self, raw: str | None = None, date_from: str | None = None, date_to: str | None = None) -> list[str]:
        """Redo all dates, or those from .. to: from the raw files, or without them the aggregates only."""
        if raw is None:
            dates = [d for d in self.dates("parsed") if (date_from or d) <= d <= (date_to or d)]
            self.refresh(dates)
            return dates
        found = storage.list_raw(self.spark, raw).select("log_date").distinct().collect()  # one row per day
        dates = sorted({r.log_date for r in found if (date_from or r.log_date) <= r.log_date <= (date_to or r.log_date)})
        return self.ingest(raw, dates)

    def load_parsed(self, raw_lines: DataFrame, dates=()) -> None:
        """Parse, label and write lines, replacing their dates and the listed ones.

        The fields of the lines are written first. Their distinct values extend the dictionaries, and a line then
        looks its labels up; no line is shuffled but by a dictionary too large to broadcast.
        """
        with self.change() as change:
            fields_table = "_work/fields"
            fields = enrich.parse_lines(raw_lines.select("date", "value"))
            found = change.write(fields_table, fields)
            requests = change.read(fields_table, fields.schema, found)
            labels = Dictionaries(change, self.rules)
            labels.extend(requests)
            rows = enrich.enrich(requests, self.rules, labels)
            if self.clustered:
                change.write("parsed", rows.sortWithinPartitions("date", "path", "ts_utc"), dates, options=storage.LOOKUP_OPTIONS)
            else:
                change.write("parsed", rows, dates)
            change.forget(fields_table)

    # Aggregates ---------------------------------------------------------------------------------------

    def refresh(self, dates: list[str]) -> None:
        """Rebuild every aggregate table for some dates.

        The requests are read four times in all: once per rollup and once for the referer flow. The rollups
        are written tables, so the aggregates read far fewer rows and a lost executor costs little.
        """
        with self.change() as change:
            parsed, rollups = self.parsed(dates), {}
            for name, build in ROLLUPS.items():
                rows, table = build(parsed), f"_work/{name}"
                found = change.write(table, storage.by_date(rows))
                rollups[name] = change.read(table, rows.schema, found)
            source = {**dict.fromkeys(aggregates.FROM_TRAFFIC, "traffic"), **dict.fromkeys(aggregates.FROM_PAGES, "pages"),
                      **dict.fromkeys(aggregates.FROM_UTM, "utm")}
            for name, build in aggregates.TABLES.items():
                if name == "hourly" and self.time_zone:
                    rows = aggregates.hourly(parsed, time_zone=self.time_zone)
                else:
                    rows = build(rollups[source[name]] if name in source else parsed)
                change.write(f"aggregates/{name}", storage.by_date(rows), dates)
            change.write("aggregates/visitor_sketches", storage.by_date(sketches.visitor_sketches(parsed)), dates)
            found = change.write("aggregates/field_values", storage.by_date(suggestions.field_values(parsed)), dates)
            values = change.read("aggregates/field_values", VALUES, found)
            change.write("aggregates/field_grams", storage.by_date(suggestions.field_grams(values)), dates)
            self.refresh_search(dates, rollups["pages"])
            for name in ROLLUPS:
                change.forget(f"_work/{name}")

    def load_search(self, perf: DataFrame, dates=()) -> list[str]:
        """Replace search data of its dates (and the listed ones) and rebuild their search tables. Returns the dates."""
        with self.change() as change:
            found = change.write("search_perf", schema.conform(perf, schema.SEARCH_PERF), dates)
            affected = sorted({*found, *dates})
            if crawled := [d for d in affected if d in self.dates("parsed")]:
                self.refresh_search(crawled)
        return affected

    def refresh_search(self, dates: list[str], pages: DataFrame | None = None) -> None:
        """Rebuild the two search tables of some dates; dates without search data are skipped."""
        with self.change() as change:
            perf = self.search_perf(dates)
            crawls = pages if pages is not None else self.parsed(dates)
            for name, build in SEARCH_TABLES.items():
                change.write(f"aggregates/{name}", storage.by_date(build(crawls, perf)), dates)

    def backfill_search(self) -> list[str]:
        """Build the search tables of dates that have requests and search data but lack either table."""
        dates = self.missing_search_dates()
        if dates:
            self.refresh_search(dates)
        return dates

    def fix_country_type(self) -> list[str]:
        """Rewrite the dates that have files whose country is not text; returns them. A second call writes nothing."""
        change = self.store.begin()
        dates = storage.repair_column(change, "parsed", schema.PARSED, "country")
        if dates:
            change.commit()
        return dates
