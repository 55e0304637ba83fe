"""Fraud-link analytics on Spark DataFrames: access logs, transactions and ledgers."""
