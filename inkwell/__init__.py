"""Analytics over research corpora, and preparation of training text, on Spark DataFrames."""
