"""Cryptographic inventory analytics on Spark."""
