"""Recruiting analytics and text-corpus preparation as plain PySpark DataFrame functions."""
