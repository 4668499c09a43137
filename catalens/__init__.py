"""Catalens: cleaning and analysis of large, messy catalog tables on Spark."""
