"""Civic text and records analytics on Spark."""
