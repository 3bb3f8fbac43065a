"""tidewater: a Spark-first engine for regularly sampled series and corpus preparation."""
