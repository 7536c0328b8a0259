"""Phone-number analytics on Spark: DataFrame operators over a dial plan."""
