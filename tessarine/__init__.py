"""Tiled, embedding-rich data as DataFrames: scoring, spatial top-k, rasters, ledgers and traces on Spark."""
