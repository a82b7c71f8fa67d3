"""Spark-native engine for curated knowledge networks and the documents behind them."""
