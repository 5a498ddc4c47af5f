"""vettle: document screening, ranking and event-fold operators on Spark DataFrames."""
