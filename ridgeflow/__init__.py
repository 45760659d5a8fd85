"""Trail-activity and recovery analytics as Spark DataFrame operators."""
