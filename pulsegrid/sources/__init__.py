"""Parquet sources and sinks on any filesystem Spark can reach (file, hdfs, abfss, s3a, gs)."""
