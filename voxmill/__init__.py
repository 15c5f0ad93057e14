"""Volumetric segmentation analytics on Spark DataFrames."""
