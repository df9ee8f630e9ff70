"""netsight: network-log threat detection on Spark DataFrames."""
