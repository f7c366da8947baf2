"""Spark-native preparation, scoring and auditing of long sectioned filings."""
