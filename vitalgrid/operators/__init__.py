"""DataFrame operators: filters, joins, aggregates, ordered passes, models."""
