"""Spark-native engine for questions over filings: passages, reported figures, checks and their service data."""
