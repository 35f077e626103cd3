"""Security- and build-telemetry operators for PySpark DataFrames and streams."""
