"""Analytics over measurement data of quality-constrained encoding experiments, as Spark DataFrames."""
