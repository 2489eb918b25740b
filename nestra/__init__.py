"""nestra: nested-record analytics and training-data operators on PySpark."""
