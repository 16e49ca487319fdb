"""PySpark-native analytics for geochemical samples, patch pixels and out-of-fold predictions."""
