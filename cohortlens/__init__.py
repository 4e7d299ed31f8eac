"""Learning-activity analytics and dropout-risk scoring on PySpark DataFrames."""

__version__ = "0.1.0"
