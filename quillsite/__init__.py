"""Spark-native analytics and training over data split by site."""
