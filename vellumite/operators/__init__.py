"""DataFrame operators: aggregates, ordered sequences, joins, page layout."""
