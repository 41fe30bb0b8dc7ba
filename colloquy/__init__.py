"""colloquy — conversation analytics on Spark DataFrames."""
