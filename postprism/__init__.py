"""Posting-market analytics as Spark DataFrame operators."""

from postprism.star import Star

__all__ = ["Star"]
