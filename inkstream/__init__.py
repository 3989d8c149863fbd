"""Long-form text, timelines and job state as Spark DataFrames."""
