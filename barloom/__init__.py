"""barloom: Spark DataFrame operators for market-bar, news and forum signal analytics."""

__version__ = "0.1.0"
