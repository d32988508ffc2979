def load_catalogue():
    """(queries, oracles); importing the query modules registers them."""
    from shellsieve.plans import auditing, catalogue, corpus, evaluation, scoring  # noqa: F401
    return catalogue.QUERIES, catalogue.ORACLES
