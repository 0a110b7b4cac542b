"""graphskein: graph analytics and skew-safe data processing on PySpark DataFrames."""
