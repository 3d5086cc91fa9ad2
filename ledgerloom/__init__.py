"""Spark-native analytics over ledgers: transactions, documents, reconciliation, behaviour."""
