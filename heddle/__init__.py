"""heddle: two-space hybrid matching and corpus preparation, expressed as Spark plans."""
