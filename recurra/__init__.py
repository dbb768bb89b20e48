"""Recurrent-event analytics on Spark."""
