"""augury: profiling, tabular preparation and training, and forecasting of many series as Spark jobs."""
