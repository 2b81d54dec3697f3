"""Larkspur: relational, temporal and learning operators written as Spark DataFrame programs."""
