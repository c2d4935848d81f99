"""tesserae: a PySpark-native memory store, hybrid-retrieval and corpus-analytics engine."""
