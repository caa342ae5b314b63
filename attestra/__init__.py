"""Document-evidence analytics on Spark: parse positioned text, match candidates with requirements, evaluate."""
