"""Weather observations, bulletins and their evaluation as Spark DataFrame operators."""
