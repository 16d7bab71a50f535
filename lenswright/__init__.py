"""lenswright: dataset auditing, model evaluation and claim assessment on Spark DataFrames."""
