"""Record resolution and cleaning engine for PySpark."""
