"""Operators of the table engine. Each takes a DataFrame and gives one; none runs a job unless it says so."""
