"""Marketing-event analytics on Spark: ingest, features, scoring, attribution, reports."""
