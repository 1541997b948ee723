"""Training-data operators: ten document, page and vector stages built on Spark."""
