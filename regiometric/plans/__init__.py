"""Composite results: the regional feature mart and the two reports."""

from regiometric.plans.mart import MartSettings, MartTables, mart_features, region_mart
from regiometric.plans.reports import cross_report, occupation_report

__all__ = ["MartSettings", "MartTables", "cross_report", "mart_features", "occupation_report", "region_mart"]
