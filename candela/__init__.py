"""Market time series on Spark: a star schema of daily bars, derived metrics, analyses and integrity checks."""
