"""Market-panel analytics as Spark DataFrame operators."""
