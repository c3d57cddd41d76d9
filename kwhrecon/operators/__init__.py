"""DataFrame -> DataFrame operators built from native Spark expressions."""
