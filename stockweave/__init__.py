"""stockweave: demand history, forecasting and stock planning as Spark DataFrame jobs."""

__version__ = "0.1.0"
