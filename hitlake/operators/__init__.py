"""Report, model, enrichment and load operators."""
