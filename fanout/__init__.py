"""fanout: nested telemetry ingest, and the evidence that an ingest was right, as Spark jobs."""
