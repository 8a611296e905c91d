"""sparkloom: a PySpark-native search, matching and data-processing engine."""
