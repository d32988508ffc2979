"""Operators for preparing training text. Nothing outside this package imports it."""


def load_queries():
    """(queries, oracles) of the ten operators and the pipeline."""
    from shellsieve.llm import catalogue
    return catalogue.QUERIES, catalogue.ORACLES
