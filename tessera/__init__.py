"""PySpark-native analytics over georeferenced raster tile pyramids."""
