"""Spark ML jobs: late delivery, repeat purchase, customer segments."""
