"""DataFrame operators: cleaning, audits, routing, features, models, evaluation, retrieval."""
