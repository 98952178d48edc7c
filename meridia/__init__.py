"""meridia: a PySpark-native analytics engine for education-opportunity data."""
