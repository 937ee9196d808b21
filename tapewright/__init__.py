"""tapewright: market-microstructure analytics as PySpark DataFrame operators."""
