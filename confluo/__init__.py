"""Confluo: event fusion, country risk and dashboards as Spark DataFrame jobs."""
