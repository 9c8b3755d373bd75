"""Queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import abuse, encode, groups, names, packing, sources
from graphloom.queries import _uuid_sql, table
from graphloom.session import ship

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark, folder):
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


_GROUPS_SQL = f"""
pairs as (select {_uuid_sql('a_id')} a, {_uuid_sql('b_id')} b, confidence from match_candidates),
every as (select distinct r from (select a r from pairs union all select b from pairs) where r is not null),
both_ways as (select distinct u, v from (select a u, b v from pairs where confidence >= 0.9::float and not isnan(confidence) union all select b, a from pairs where confidence >= 0.9::float and not isnan(confidence)) where u is not null and v is not null and u <> v),
walk as (select r as record_id, r as reached from every union select w.record_id, e.v from walk w join both_ways e on e.u = w.reached),
grouped as (select record_id, min(reached) group_id from walk group by 1)
"""


@query("p6_found", f"with recursive {_GROUPS_SQL} select record_id, group_id from grouped")
def p6_found(spark, folder):
    return groups.groups(table(spark, folder, "match_candidates"))


@query("p6_group_sizes", f"with recursive {_GROUPS_SQL} select n group_size, count(*) n_groups from (select group_id, count(*) n from grouped group by 1) group by 1")
def p6_group_sizes(spark, folder):
    from pyspark.sql import functions as F

    sizes = groups.groups(table(spark, folder, "match_candidates")).groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


@query("p7_ids")
def p7_ids(spark, folder):
    return encode.encode_documents(table(spark, folder, "documents"))


@query("p7_totals")
def p7_totals(spark, folder):
    """Tokens and characters by source, as written."""
    from pyspark.sql import functions as F

    n = table(spark, folder, "documents").select("source", F.length("text").alias("c"), encode.token_count(F.col("text")).alias("n"))
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_characters"), F.sum("n").alias("n_tokens"))


@query("p1_found")
def p1_found(spark, folder):
    return names.found(table(spark, folder, "authors"))


@query("p1_entities")
def p1_entities(spark, folder):
    """Every row with the smallest author_id of its entity and the number of its spellings."""
    from pyspark.sql import functions as F

    e = names.entities(table(spark, folder, "authors"))
    return e.join(e.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows")), "entity_id").select("author_id", "entity_id", "n_rows")


@query("p4_found")
def p4_found(spark, folder):
    return sources.parse_errors(table(spark, folder, "source_files")).select("file_id")


@query("p4_rates")
def p4_rates(spark, folder):
    return sources.rates(table(spark, folder, "source_files"))


@query("p4_errors")
def p4_errors(spark, folder):
    """Kind, token and line of each error."""
    return sources.parse_errors(table(spark, folder, "source_files")).select("file_id", "language", "error", "token", "line")


@query("p8_containers")
def p8_containers(spark, folder):
    return packing.containers(table(spark, folder, "documents"))


@query("p8_usage")
def p8_usage(spark, folder):
    return packing.usage(packing.containers(table(spark, folder, "documents")))


@query("p9_found")
def p9_found(spark, folder):
    return abuse.found(table(spark, folder, "documents"), table(spark, folder, "review_labels"))


@query("p9_scores")
def p9_scores(spark, folder):
    return abuse.scores(table(spark, folder, "documents"), table(spark, folder, "review_labels"))


@query("p9_rates")
def p9_rates(spark, folder):
    return abuse.rates(table(spark, folder, "documents"), table(spark, folder, "review_labels"))
