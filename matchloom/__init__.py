"""Match-telemetry analytics and training-data operators on Spark DataFrames."""
