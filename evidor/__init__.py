"""Analytics over an append-only ledger of work, as Spark DataFrames."""
