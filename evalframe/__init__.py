"""evalframe: labelled-data and model-evaluation analytics as Spark DataFrame operators."""
