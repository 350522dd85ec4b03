"""Regression models and their comparison, through Spark ML."""
