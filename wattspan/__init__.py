"""Analytics over power-system planning and operations data, as Spark DataFrames."""
