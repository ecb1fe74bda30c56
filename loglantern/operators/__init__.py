"""DataFrame operators: filters, reports, ranking, search, embedding and classification."""
