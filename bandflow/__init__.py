"""Trade-flow analytics expressed as Spark DataFrame operators."""
