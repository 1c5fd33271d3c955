"""Spark-native analytics for medical-imaging tables: studies, series, instances, elements, slices and frames."""
