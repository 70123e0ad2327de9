"""Meterlake: smart-meter analytics and corpus preparation as Spark DataFrame jobs."""
