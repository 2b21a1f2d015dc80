"""Spark-native analytics for student-loan portfolios and transfer-fund balances."""
