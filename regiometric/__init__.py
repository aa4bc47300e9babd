"""Regional workforce analytics as lazy Spark DataFrame operations."""

from regiometric.session import shared_dir, spark_session

__all__ = ["shared_dir", "spark_session"]
