"""Readers with explicit schemas and writers."""

from regiometric.sources.geojson import parse_features, read_geojson
from regiometric.sources.layout import attach_stored, publish_report, read_published, write_bucketed
from regiometric.sources.readers import (
    load_csv,
    observed,
    read_csv,
    read_jdbc,
    read_parquet,
    read_rates_csv,
    rejected_codes,
    with_text_codes,
)
from regiometric.sources.sinks import write_csv, write_parquet, write_report

__all__ = [
    "attach_stored", "load_csv", "observed", "parse_features", "publish_report", "read_csv", "read_geojson", "read_jdbc",
    "read_parquet", "read_published", "read_rates_csv", "rejected_codes", "with_text_codes", "write_bucketed", "write_csv",
    "write_parquet", "write_report",
]
