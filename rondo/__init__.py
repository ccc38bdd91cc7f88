"""Match analytics on Spark: ratings, point-in-time features, calibration and monitoring."""
