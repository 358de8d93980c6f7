"""Land-opportunity analytics as Spark DataFrame programs."""
