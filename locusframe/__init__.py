"""Variant-call tables (VCF) on Spark: view, concat and merge as DataFrame plans."""
