"""Registered queries over the tables of a folder."""


def all_sets() -> list:
    from kelpie.plans.core_queries import CORE
    from kelpie.plans.corpus_queries import CORPUS
    from kelpie.plans.graph_queries import GRAPH
    from kelpie.plans.retrieval_queries import RETRIEVAL

    return [CORE, RETRIEVAL, GRAPH, CORPUS]
