"""Conversational-evidence analytics on Spark."""
