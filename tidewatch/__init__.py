"""Session and episode analytics on Spark DataFrames and Structured Streaming."""
