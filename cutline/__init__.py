"""Point-in-time analytics for competitors in ordered events, on Spark DataFrames."""
