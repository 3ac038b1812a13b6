"""Transit headway, delay-drift and bunching analytics as Spark DataFrame operators."""
