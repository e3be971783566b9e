"""Localization-catalog analytics and text-corpus operators on PySpark."""
