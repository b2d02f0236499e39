"""Detection of loud, well-separated moments in many time series, on Spark."""
