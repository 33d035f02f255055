"""Named queries and named filter sets. Explicit arguments always win over the named ones."""

from __future__ import annotations

from dataclasses import fields, replace

from hitloom.operators.filters import FilterSpec
from hitloom.operators.query import QuerySpec


def _group(group_by: str, second: str | None = None, sort_by: str = "hits", **f) -> QuerySpec:
    return QuerySpec(mode="group", group_by=group_by, group_by_2=second, sort_by=sort_by, filters=FilterSpec(**f))


def _series(stack_by: str, bucket: str = "day", **f) -> QuerySpec:
    return QuerySpec(mode="timeseries", stack_by=stack_by, bucket=bucket, filters=FilterSpec(**f))


_PAGES = {"include_assets": False}
_GOOGLE = {"is_bot": True, "include": {"bot_family": ("Googlebot",)}, "include_assets": False}

PRESETS: dict[str, QuerySpec] = {
    "top-4xx": _group("path", include={"status_class": (4,)}, **_PAGES),
    "top-5xx": _group("path", include={"status_class": (5,)}, **_PAGES),
    "top-3xx": _group("path", include={"status_class": (3,)}, **_PAGES),
    "top-404": _group("path", include={"status": (404,)}, **_PAGES),
    "top-urls": _group("path", is_bot=False, **_PAGES),
    "url-groups": _group("url_group"),
    "bot-families": _group("bot_family", is_bot=True),
    "bot-categories": _group("bot_category", is_bot=True),
    "crawl-waste": _group("path", sort_by="waste_score", is_bot=True),
    "googlebot-segments": _group("path_segment_1", **_GOOGLE),
    "googlebot-subsegments": _group("path_segment_1", "path_segment_2", **_GOOGLE),
    "googlebot-depth": _group("path_depth", **_GOOGLE),
    "bot-segments": _group("path_segment_1", is_bot=True, **_PAGES),
    "heavy-urls": _group("path", sort_by="bytes", **_PAGES),
    "top-countries": _group("country"),
    "top-locales": _group("locale"),
    "utm-sources": _group("utm_source_norm"),
    "internal-nav": _group("referer_path", "path", include={"referer_type": ("Internal",)}),
    "referer-types": _group("referer_type"),
    "traffic": _series("is_bot"),
    "hourly-traffic": _series("is_bot", "hour"),
    "status-over-time": _series("status_class"),
    "errors-over-time": _series("status_class", include={"status_class": (4, 5)}),
    "methods-over-time": _series("method"),
    "url-groups-over-time": _series("url_group"),
    "bot-families-over-time": _series("bot_family", is_bot=True),
    "countries-over-time": _series("country"),
    "referers-over-time": _series("referer_type"),
}

VIEWS: dict[str, FilterSpec] = {
    "all": FilterSpec(),
    "errors": FilterSpec(include={"status_class": (4, 5)}),
    "top-404": FilterSpec(include={"status": (404,)}),
    "ai-bots": FilterSpec(include={"bot_category": ("AI Crawler",)}, is_bot=True),
    "humans": FilterSpec(is_bot=False),
    "paid": FilterSpec(include={"utm_source": ("google_ads", "newsletter", "chatgpt")}),
}


def preset(name: str, date_from: str | None = None, date_to: str | None = None, status=(), url_group=()) -> QuerySpec:
    """A named query over a date range. A status is added only when the preset sets none."""
    spec = PRESETS[name]
    include = dict(spec.filters.include)
    if status and not {"status", "status_class"} & set(include):
        include["status"] = tuple(status)
    if url_group:
        include["url_group"] = tuple(url_group)
    return replace(spec, date_from=date_from or spec.date_from, date_to=date_to or spec.date_to,
                   filters=replace(spec.filters, include=include))


def with_view(view: str, given: FilterSpec | None = None) -> FilterSpec:
    """A named filter set as the default for whatever ``given`` leaves open."""
    base, given = VIEWS.get(view, FilterSpec()), given or FilterSpec()
    unset = {f.name: getattr(base, f.name) for f in fields(FilterSpec)
             if f.name != "include" and getattr(given, f.name) == getattr(FilterSpec(), f.name)}
    return replace(given, include={**base.include, **given.include}, **unset)
