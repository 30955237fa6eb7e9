"""scribegauge: a Spark-first engine for scoring, auditing and preparing transcripts and text corpora."""
