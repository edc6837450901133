"""textbench: labelled-text analytics as Spark DataFrame jobs."""
