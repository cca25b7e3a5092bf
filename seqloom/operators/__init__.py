"""DataFrame operators: cleaning, joins, pooling, metrics, reports, clustering."""
