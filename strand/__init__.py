"""Spark-native low-rank time-varying regression and corpus operators."""
