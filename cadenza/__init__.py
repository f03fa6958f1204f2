"""Transcript analytics and time-coded text operators on Spark."""
