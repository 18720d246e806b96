"""A Spark-native engine for rolling-origin retail forecast backtests."""
