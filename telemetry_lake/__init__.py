"""Grid telemetry on Spark: bronze, silver and gold layers, failure-risk alerts and their outbox."""
