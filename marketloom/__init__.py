"""marketloom: market-rotation analytics on Spark."""
