"""braidwork: a PySpark-native engine for sequences, sequence graphs and the tables derived from them."""
