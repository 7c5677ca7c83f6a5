"""Population exposure to natural hazard, by susceptibility band, as Spark jobs."""
