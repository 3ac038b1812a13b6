"""Registered queries and the SQL they are checked against."""


def all_registries():
    from transit_spark.plans import evaluation_queries, headway_queries, model_queries, realtime_queries, source_queries

    modules = (headway_queries, realtime_queries, evaluation_queries, model_queries, source_queries)
    return [m.reg for m in modules]
