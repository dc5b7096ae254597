"""A Spark-first engine for transient analytics over photon event tables."""
