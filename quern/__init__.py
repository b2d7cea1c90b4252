"""quern: a PySpark-native engine for versioned, policy-governed context data."""
