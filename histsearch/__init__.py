"""histsearch: search and browse conversation history with Spark DataFrames."""
