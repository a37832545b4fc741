"""Analytics over hash-sharded tables on Spark."""
