"""Time-series analytics on Spark: indicators, alignment joins, backtests, risk and monitoring over long bar tables."""
