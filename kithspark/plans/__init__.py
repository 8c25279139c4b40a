"""Query definitions over the driver's tables."""


def all_registries() -> list:
    from kithspark.plans import placement_queries, relation_queries, skew_queries, vector_queries

    return [relation_queries.R, vector_queries.R, placement_queries.R, skew_queries.R]
