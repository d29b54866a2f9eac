"""Content curation on Spark: harvest community posts, build curated feeds."""
