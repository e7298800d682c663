"""Unit-value analytics and training-data operators on PySpark."""
