"""Analytics over Spark DataFrames: market data, risk, portfolios, text, retrieval, monitoring."""
