"""Binary-outcome risk studies as Spark DataFrame jobs."""
