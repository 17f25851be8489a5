"""Slot-series analytics on Spark: align, fill, enrich, feature, split, forecast, score."""
