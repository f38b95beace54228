"""Evidence-graph analytics as Spark plans."""
