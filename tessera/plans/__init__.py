"""Query catalog (Spark side) and SQL oracles."""
