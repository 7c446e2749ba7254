"""Gleaner: documentation and text analytics as Spark DataFrame operators."""
