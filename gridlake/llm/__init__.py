"""Training-data operators: deduplication, language, toxicity, decontamination,
sharding, tokenisation, web archives, URL and quality rules.

Every operator module has a general operator (its own columns and options) and a
thin ``opN_<name>(spark, sf_dir)`` query over the given tables.
"""
