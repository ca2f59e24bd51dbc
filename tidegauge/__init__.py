"""Demand forecasting, capacity planning and corpus preparation as Spark jobs."""
