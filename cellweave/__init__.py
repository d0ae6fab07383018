"""Analytics on tables of regular two-dimensional grids, written for Spark."""
