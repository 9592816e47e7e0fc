"""Historian sources: a query over a long table, described by recipe options."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.names import clean_text, match_key, match_key_column, parse_name_list, require_names
from ..operators.series import (
    event_frames,
    interpolate,
    recorded,
    resolve_time,
    rows_per_tag,
    snapshot,
    summarize,
    summary_functions,
    to_wide,
)
from .specs import SERIES_KINDS

# Fixed values of the recipe format.
QUERY_TYPES = ("snapshot", "recorded", "interpolated", "summary")
DEFAULT_START, DEFAULT_END, DEFAULT_INTERVAL = "*-1d", "*", "1h"


@dataclass(frozen=True)
class SeriesQuery:
    source_kind: str
    query_type: str
    names: tuple[str, ...]
    element: str
    start_time: str
    end_time: str
    interval: str
    functions: tuple[str, ...]
    max_rows: int | None
    template: str

    @classmethod
    def from_options(
        cls, source_kind: str, options: Mapping[str, object], rows: int | None = None
    ) -> "SeriesQuery":
        """No cap per tag unless the options name one; ``rows`` lowers it for a preview."""
        if source_kind not in SERIES_KINDS:
            raise PlanError(f"not a series source: {source_kind}")
        text = lambda name, default="": clean_text(options.get(name) or default) or default
        listed = {
            "pi_da_tag": ("tags_text", "tag"),
            "af_attribute": ("af_attributes_text", "attribute"),
            "af_event_frame": ("ef_analyses_text", "analysis"),
        }[source_kind]
        kind = text("query_type", "recorded").lower()
        wanted = options.get("summary_functions") or ()
        if isinstance(wanted, str):
            wanted = parse_name_list(wanted)
        caps = [c for c in (rows_per_tag(options.get("max_rows_per_tag")), rows_per_tag(rows)) if c]
        query = cls(
            source_kind=source_kind,
            query_type=kind if kind in QUERY_TYPES else "recorded",
            names=require_names(parse_name_list(options.get(listed[0])), listed[1]),
            element=text("af_element"),
            start_time=text("start_time", DEFAULT_START),
            end_time=text("end_time", DEFAULT_END),
            interval=text("interval", DEFAULT_INTERVAL),
            functions=summary_functions(wanted),
            max_rows=min(caps, default=None),
            template=text("ef_template"),
        )
        if source_kind == "af_attribute" and not query.element:
            raise PlanError("attribute values need an element")
        if source_kind == "af_event_frame" and not query.template:
            raise PlanError("event frames need a template")
        return query


def series_rows(df: DataFrame, query: SeriesQuery, now: datetime | None = None) -> DataFrame:
    """Long rows of a tag or attribute query.

    ``df`` has tag, timestamp and value (and is_good); for attributes it has
    element and attribute in place of tag.
    """
    rows, names = df, list(query.names)
    if query.source_kind == "af_attribute":
        rows = rows.where(match_key_column("element") == match_key(query.element))
        rows = rows.withColumn("tag", F.col("attribute")).drop("element", "attribute")
    if query.query_type == "snapshot":
        rows = snapshot(rows, names).withColumn("source_type", F.lit("snapshot"))
    elif query.query_type == "interpolated":
        rows = interpolate(
            rows, query.start_time, query.end_time, query.interval, query.max_rows, names, now=now
        )
    else:
        # A summary is one of all rows.
        cap = None if query.query_type == "summary" else query.max_rows
        rows = recorded(rows, query.start_time, query.end_time, cap, names, now=now)
        if query.query_type == "summary":
            # A relative start does not anchor the windows; the first value does.
            start = query.start_time if "*" not in query.start_time else None
            start = start if resolve_time(start, now) else None
            rows = summarize(rows, query.interval, query.functions, start)
        else:
            rows = rows.withColumn("source_type", F.lit("recorded"))
    if query.source_kind == "af_attribute":
        rows = rows.withColumns({
            "element": F.lit(query.element),
            "attribute": F.col("tag"),
            "source_type": F.concat(F.lit("af_"), F.col("source_type")),
        })
    return rows


def series_table(df: DataFrame, query: SeriesQuery, now: datetime | None = None) -> DataFrame:
    """The table a plan sees: one column per tag, or one row per event frame."""
    if query.source_kind == "af_event_frame":
        return event_frames(
            df, query.template, query.start_time, query.end_time, query.names, now
        )
    return to_wide(series_rows(df, query, now))
