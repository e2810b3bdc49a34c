"""docketlake: a PySpark-native engine for hybrid document retrieval and its evaluation."""
