from veinstone.registry import answers, catalog, retrieval
from veinstone.registry.base import Query


def all_queries() -> list[Query]:
    return [*retrieval.group.queries, *answers.group.queries, *catalog.group.queries]
