"""Spark-native analytics for affinity-selection sequencing data."""

__version__ = "0.1.0"
