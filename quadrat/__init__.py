"""An annotation-analytics and training-data engine on PySpark."""
