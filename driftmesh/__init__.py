"""driftmesh: feature extraction and tracking in time-varying fields, on Spark DataFrames."""

__version__ = "0.1.0"
