"""folioscope: corpus-scale document and translation analytics on Spark."""
