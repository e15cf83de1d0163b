"""DataFrame operators: profiling, vocabularies, topic models, metrics, reports."""
