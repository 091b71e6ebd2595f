"""Barograph: causal market-structure analytics on Spark DataFrames."""
