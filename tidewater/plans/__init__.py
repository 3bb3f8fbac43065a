"""Registered queries; importing this package files them in the registry."""

from tidewater.plans import forecast_queries, io_queries, quality_queries, series_queries  # noqa: F401
