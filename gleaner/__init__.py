"""A PySpark-native engine for text indexing, ranking, consolidation, linting and training-data preparation."""
