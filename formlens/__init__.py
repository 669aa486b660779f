"""Layout-aware PII analytics on Spark: evaluation, diversity, curation and conversion of annotated documents."""
