"""Order-book analytics on Spark: capture, storage, replay and inspection of level-2 market data."""
