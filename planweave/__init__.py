"""planweave: zone-plan analytics as ordinary Spark jobs."""
