"""Log normalisation and event analytics as Spark DataFrame operators."""
