"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.operators import graph as G
from legajo.plans.registry import query
from legajo.plans.texts import sql_fold
from legajo.session import materialize, read

_MENTIONS = f"""r as (select doc_id, unnest(persons) as name, 'person' as entity_type from documents_x union all select doc_id, unnest(organizations), 'organization' from documents_x),
    m as (select doc_id, {sql_fold('name')} as key, name, entity_type from r where {sql_fold('name')} <> '')"""
_NODES = "n as (select key, min(name) as name, min(entity_type) as entity_type, count(*) as mentions, count(distinct doc_id) as n_docs from m group by key)"
_EDGES = """dk as (select distinct doc_id, key from m),
    e as (select a.key as src, b.key as dst, count(*) as weight from dk a join dk b on a.doc_id = b.doc_id and a.key < b.key group by 1, 2),
    w as (select src, dst, weight from e union all select dst, src, weight from e)"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return G.mentions(read(spark, d, "documents_x"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return materialize(G.edges(_mentions(spark, d)), "edges")


@query(f"with {_MENTIONS}, {_NODES} select key, name, entity_type, mentions, n_docs from n")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(_mentions(spark, d))


@query(f"with {_MENTIONS}, {_EDGES} select src, dst, weight from e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(_mentions(spark, d))


@query(f"""with {_MENTIONS}, {_NODES}, l as (select key as target, entity_type, unnest(list_distinct(string_split(key, ' '))) as w from n),
    p as (select n.key, l.target, row_number() over (partition by n.key order by len(l.target) desc, l.target) as rk from n join l on l.entity_type = n.entity_type and l.w = split_part(n.key, ' ', 1)
          where n.key <> l.target and contains(' ' || l.target || ' ', ' ' || n.key || ' '))
    select n.key, coalesce(p.target, n.key) as target from n left join p on p.key = n.key and rk = 1""")
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_targets(G.nodes(_mentions(spark, d)))


@query(f"with {_MENTIONS}, {_EDGES} select src as key, count(*) as degree, sum(weight)::bigint as strength from w group by src")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


@query(f"with {_MENTIONS}, {_EDGES}, near as (select *, row_number() over (partition by src order by weight desc, dst) as rk from w) select src, dst, weight, rk from near where rk <= 10")
def graph_related(spark: SparkSession, d: str) -> DataFrame:
    return G.related(_edges(spark, d))


@query(f"""with {_MENTIONS}, {_NODES}, {_EDGES}
    select entity_type, count(*) as entities, sum(mentions)::bigint as mentions, (select count(*) from e) as edges, (select sum(weight)::bigint from e) as weight from n group by entity_type""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    e = G.edges(m).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
    return G.nodes(m).groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.sum("mentions").alias("mentions")).crossJoin(F.broadcast(e))  # one row


@query(f"""with recursive {_MENTIONS}, {_EDGES}, s as (select min(src) as key from w),
    b(key, hops) as (select key, 0 from s union select w.dst, b.hops + 1 from b join w on w.src = b.key where b.hops < 3) select key, min(hops)::int as hops from b group by key""")
def graph_distances(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.distances(e, G.both_ways(e).agg(F.min("src").alias("key")), 3)


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """(community, label, members, strength): communities by label propagation over the whole graph, each named after its most mentioned member."""
    m = materialize(_mentions(spark, d), "mentions")
    e = materialize(G.edges(m), "edges")
    by = G.label_communities(e).join(G.degrees(e), "key").join(G.nodes(m), "key").groupBy("community")
    return by.agg(F.min_by("name", F.struct((-F.col("mentions")).alias("m"), "key")).alias("label"), F.count(F.lit(1)).alias("members"), F.sum("strength").alias("strength"))


@query()
def community_members(spark: SparkSession, d: str) -> DataFrame:
    """(community, key, mentions, place): the members of each community, a row each, the most mentioned first."""
    m = materialize(_mentions(spark, d), "mentions")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("mentions"), "key"))
    return G.label_communities(G.edges(m)).join(G.nodes(m), "key").select("community", "key", "mentions", place.cast("long").alias("place"))


@query()
def top_brokers(spark: SparkSession, d: str) -> DataFrame:
    """(key, name, betweenness, mentions, n_docs, rank): the twenty entities that join most others, those alone that join any."""
    m = materialize(_mentions(spark, d), "mentions")
    best = G.all_betweenness(G.edges(m)).orderBy(F.desc(F.round("betweenness", 9)), "key").limit(20).filter("betweenness > 0")
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("betweenness", 9)), "key"))  # twenty rows
    return best.join(G.nodes(m), "key").select("key", "name", "betweenness", "mentions", "n_docs", rank.cast("long").alias("rank"))


@query()
def graph_brokers(spark: SparkSession, d: str) -> DataFrame:
    """(key, betweenness): exact, over the shortest paths between all entities."""
    return G.all_betweenness(_edges(spark, d))


@query("""with e as (select doc_id, unnest(persons) as person from documents_x)
       select person, count(distinct doc_id) as docs from e join (select name from entity_nodes where entity_type = 'person') k on k.name = e.person group by person""")
def directory_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each directory person, by an equi-join of exploded names with the directory."""
    names = read(spark, d, "documents_x").select("doc_id", F.explode("persons").alias("person"))
    known = read(spark, d, "entity_nodes").filter("entity_type = 'person'").select(F.col("name").alias("person"))
    return names.join(known, "person").groupBy("person").agg(F.countDistinct("doc_id").alias("docs"))
