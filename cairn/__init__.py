"""cairn: analytics of content-addressed object stores and their logs, as Spark DataFrames."""
