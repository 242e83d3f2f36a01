"""changelens: change-verification analytics expressed as Spark DataFrames."""
