"""Spark-first panel analytics: panels, as-of features, forecasts, shift detection, text signals."""
