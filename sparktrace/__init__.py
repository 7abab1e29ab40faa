"""Spark-native process-variant analytics: profile cases, link them, cluster them, explain them."""
