"""Detection, track and corpus analytics as PySpark plans."""
