"""Dataset operators: filters, deduplication, sampling, joins, mixing."""
