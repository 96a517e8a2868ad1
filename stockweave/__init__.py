"""Demand analytics for outlet/product/day facts, written as Spark DataFrame operators."""
