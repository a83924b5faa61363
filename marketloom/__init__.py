"""Asset analytics on Spark: ingest, returns, risk, features, models, scenarios and marts."""

__version__ = "0.1.0"
