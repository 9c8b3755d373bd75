"""Further queries of the core: one or more for each operator of the inventory that queries.py leaves out. Importing this adds them to its QUERIES and SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window, functions as F

from graphloom.facade import Engine
from graphloom.functions import text
from graphloom.functions.ids import canonical_uuid
from graphloom.operators import compile, context, docs, graph, identity, ledger, recovery, search, simulation
from graphloom.plans import ekl, transform
from graphloom.queries import _CROSS, _CUT, _FACTS, _FROM, _NORM, _PAGES, _R, _TOP, _UUID5, _V, _VP, _bm25_sql, _branch, _facts, _graph, _root, _searchable, _tables, _uuid_sql, query, table
from graphloom.session import cut
from graphloom.sources import readers
from graphloom.sources import tables as T

_RAT = f"ra as (select * exclude rn from (select *, row_number() over (partition by id order by created_at desc, f desc nulls last, t desc nulls last) rn from rels where created_at <= timestamp '{_CUT}') where rn = 1)"
_OAT = f"oa as (select * exclude rn from (select *, row_number() over (partition by id order by created_at desc, sig desc) rn from versions where created_at <= timestamp '{_CUT}') where rn = 1)"


def _engine(spark, folder) -> Engine:
    o, r, e, v = _tables(spark, folder, "objects", "relationships", "kir_events", "evidence")
    return Engine(T.object_versions(o), T.relationship_rows(r), e.select(canonical_uuid("id").alias("id"), "kind", canonical_uuid("subject").alias("subject"), "occurred_at"), v)


# --- the query language --------------------------------------------------------------------------------------------------

_ANCHOR = "anchor as (select min(id) id from cur where lower(name) = (select lower(name) from cur where id = (select f from top)))"


def _anchored(spark, folder, rest: str):
    """A query FROM the name of the object with the most Contains links."""
    o, r, root = _root(spark, folder)
    name = o.where(F.col("id") == root).collect()[0]["name"]
    entity, _, clauses = rest.partition(" ")
    return ekl.run(f"FIND {entity} FROM '{name}' {clauses}", o, r)


@query(
    "ekl_from",
    f"""with recursive {_V}, {_R}, {_TOP}, {_ANCHOR}, e as (select f a, t b from live union all select t, f from live),
    walk as (select id, 0 hop from anchor union select e.b, walk.hop + 1 from walk join e on e.a = walk.id where walk.hop < 1 and e.b in (select id from cur))
    select id, name, kind from cur where id in (select id from walk)""",
)
def ekl_from(spark, folder):
    return _anchored(spark, folder, "Object")


@query(
    "ekl_from_depth",
    f"""with recursive {_V}, {_R}, {_TOP}, {_ANCHOR}, e as (select f a, t b from live union all select t, f from live),
    walk as (select id, 0 hop from anchor union select e.b, walk.hop + 1 from walk join e on e.a = walk.id where walk.hop < 2 and e.b in (select id from cur))
    select id, name, null::varchar owner from cur where id in (select id from walk)""",
)
def ekl_from_depth(spark, folder):
    return _anchored(spark, folder, "Object RETURN id DEPTH 1 RETURN name, owner DEPTH 2")


@query("ekl_from_relationships", f"with {_V}, {_R}, {_TOP}, {_ANCHOR} select id, f as \"from\", t as \"to\" from live where f = (select id from anchor) or t = (select id from anchor)")
def ekl_from_relationships(spark, folder):
    return _anchored(spark, folder, "Relationship RETURN id, from, to")


@query(
    "ekl_via",
    f"""with recursive {_V}, {_R}, {_TOP}, {_ANCHOR},
    walk as (select id, 0 hop from anchor union select live.t, walk.hop + 1 from walk join live on live.f = walk.id where lower(live.kind) = 'contains' and walk.hop < 3 and live.t in (select id from cur))
    select id, name, kind from cur where id in (select id from walk)""",
)
def ekl_via(spark, folder):
    return _anchored(spark, folder, "Object VIA Contains DEPTH 3")


@query("ekl_numbers", "select doc_id::varchar id, n_chars::varchar as name from documents where try_cast(n_chars::varchar as double) > 400 and try_cast(n_chars::varchar as double) <= 900.5 and coalesce(source <> 'email', true)")
def ekl_numbers(spark, folder):
    o = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("string").alias("name"), F.col("source").alias("kind"), F.array().cast("array<string>").alias("evidence"), "created_at")
    return ekl.run("FIND Object WHERE name > 400 AND name <= 900.5 AND kind != 'email' RETURN id, name", o, o.limit(0))


_BAD = {
    "FIND Thing": 5, "FIND Object WHERE": 17, "FIND Object WHERE name ~ 'x'": 23, "FIND Object LIMIT 'x'": 18, "FIND Object VIA Contains": 24, "SELECT 1": 0, "FIND Object name": 12,
    "find object where name = 'x' and kind != 'y' limit 1 return id order by name desc limit 2": -1, "FIND Relationship FROM 'é' DEPTH 2 VIA Calls": -1,
}


@query("ekl_errors", "select * from (values {}) v(query, position)".format(", ".join("('{}', {})".format(q.replace("'", "''"), p) for q, p in _BAD.items())))
def ekl_errors(spark, folder):
    """Where queries do not parse; -1 for those that do."""

    def fault(q):
        try:
            ekl.parse(q)
            return -1
        except ekl.EklError as e:
            return e.position

    return spark.createDataFrame([(q, fault(q)) for q in _BAD], "query string, position int")


# --- the ledger ----------------------------------------------------------------------------------------------------------


@query("relationships_at", f"with {_V}, {_R}, {_RAT}, n as (select id from cur where kind = 'Repository') select n.id node_id, r.id rel_id, r.kind from ra r join n on r.f = n.id union select n.id, r.id, r.kind from ra r join n on r.t = n.id")
def relationships_at(spark, folder):
    e = _engine(spark, folder)
    nodes = e.current()[0].where("kind = 'Repository'")
    return ledger.relationships_at(e.relationships, ["created_at", "from", "to"], "created_at", _CUT, nodes).select("node_id", F.col("id").alias("rel_id"), "kind")


@query("state_at", f"with {_V}, {_OAT}, u as (select id, unnest(evidence) e from oa where kind in ('Repository', 'Table')) select distinct id object_id, e evidence_id from u where e in (select id from evidence)")
def state_at(spark, folder):
    """The evidence of repositories and tables as of a time."""
    e = _engine(spark, folder)
    nodes = e.current(_CUT)[0].where("kind in ('Repository', 'Table')")
    return e.state(nodes, _CUT)["evidence"].select("object_id", F.col("id").alias("evidence_id")).distinct()


@query(
    "observation_at",
    f"""with {_V}, {_R}, {_OAT}, {_RAT}, ok as (select * from ra where coalesce(status, 'confirmed') = 'confirmed'), a as (select id from oa where kind in ('Person', 'Module', 'File')),
    scope as (select id from a union select t from ok where lower(kind) = 'ownedby' and f in (select id from a)) select id, f as "from", t as "to" from ok where f in (select id from scope) and t in (select id from scope)""",
)
def observation_at(spark, folder):
    """What lies between persons, modules and files and whom they are owned by, as they were at a time; OwnedBy stands for Knows."""
    e = _engine(spark, folder)
    e.relationships = e.relationships.withColumn("kind", F.when(F.lower("kind") == "ownedby", "Knows").otherwise(F.col("kind")))
    return e.observation(e.current(_CUT)[0].where("kind in ('Person', 'Module', 'File')"), _CUT)["relationships"].select("id", "from", "to")


_INSIDE = f"created_at > timestamp '{_FROM}' and created_at <= timestamp '{_CUT}'"


@query("diff_lists", f"with {_V}, {_R} select 'object' entry_type, id, created_at, count(*) n from versions where {_INSIDE} group by all union all select 'relationship', id, created_at, count(*) from rels where {_INSIDE} group by all")
def diff_lists(spark, folder):
    return _engine(spark, folder).diff(_FROM, _CUT)


@query("status", f"with {_V}, {_R} select 'objects' as name, count(*) n_versions, count(distinct id) n_ids from versions union all select 'relationships', count(*), count(distinct id) from rels union all select 'events', count(*), count(distinct {_uuid_sql('id')}) from kir_events")
def status(spark, folder):
    return _engine(spark, folder).status()


@query("merged_branch", f"with {_V}, {_OAT} select id, name, kind, created_at from oa union all select id, name, kind, created_at from cur where id not in (select id from oa)")
def merged_branch(spark, folder):
    main, branch = _branch(spark, folder)
    return ledger.merged(main, branch, "id", "sig").select("id", "name", "kind", "created_at")


_RSIG = "concat_ws('|', coalesce(kind, ''), coalesce(f, ''), coalesce(t, ''), coalesce(status, ''))"


@query(
    "commit_counts",
    f"""with {_V}, {_R}, {_OAT}, {_RAT}, o as (select oa.id is null or oa.sig is distinct from cur.sig w from cur left join oa on oa.id = cur.id),
    b as (select id, {_RSIG} sig from ra), i as (select id, {_RSIG} sig from currel), r as (select b.id is null or b.sig is distinct from i.sig w from i left join b on b.id = i.id)
    select 'objects' entry_type, count(*) filter (w) n_written, count(*) filter (not w) n_skipped from o union all select 'relationships', count(*) filter (w), count(*) filter (not w) from r""",
)
def commit_counts(spark, folder):
    e = _engine(spark, folder)
    (o0, r0), (o1, r1) = e.current(_CUT), e.current()
    signed = lambda r: r.withColumn("sig", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("kind", "from", "to", "status")]))
    return ledger.commit_report(objects=ledger.commit(o0, o1, "id", "sig"), relationships=ledger.commit(signed(r0), signed(r1), "id", "sig"))


@query("fact_scan", f"with {_FACTS} select entity, tx, op, value from facts where attr = 'modified'")
def fact_scan(spark, folder):
    return ledger.scan(_facts(spark, folder).withColumn("value_type", F.lit("string")), "aevt", "modified").select("entity", "tx", "op", "value")


@query("fact_references", f"with {_R}, top as (select t from rels where t is not null group by t order by count(*) desc, t limit 1) select id entity, epoch_us(created_at) tx from rels where t = (select t from top)")
def fact_references(spark, folder):
    """The facts that refer to the target of most relationships."""
    r = T.relationship_rows(table(spark, folder, "relationships"))
    facts = r.select(F.col("id").alias("entity"), F.lit("to").alias("attr"), F.col("to").alias("value"), F.lit("ref").alias("value_type"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("tx"))
    top = facts.where("value is not null").groupBy("value").count().orderBy(F.desc("count"), "value").limit(1).collect()
    return ledger.scan(facts, "avet", "to", top[0]["value"] if top else "").select("entity", "tx")


# --- search --------------------------------------------------------------------------------------------------------------


@query("search_exact_name", _bm25_sql(["design", "note"], "200", "design_note", ("source", "lang", "text")))
def search_exact_name(spark, folder):
    d = table(spark, folder, "documents")
    some = lambda c: F.coalesce(c, F.lit(""))
    return search.search(d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), some("source").alias("name"), some("lang").alias("kind"), some("text").alias("content")), "design_note", 200)


@query("search_inverted", _bm25_sql(["ledger", "backends"]))
def search_inverted(spark, folder):
    postings, lengths = search.inverted(_searchable(spark, folder))
    return search.search_inverted(postings, lengths, "ledger backends")


@query("search_inverted_prefix", _bm25_sql(["token*", "version"]))
def search_inverted_prefix(spark, folder):
    postings, lengths = search.inverted(_searchable(spark, folder))
    return search.search_inverted(postings, lengths, "token* version")


@query("indexed_content", "select doc_id, concat_ws(' ', nullif(source, ''), nullif(lang, '')) content from documents")
def indexed_content(spark, folder):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return table(spark, folder, "documents").select("doc_id", search.indexed_text(F.create_map(F.lit("excerpt"), quoted("source"), F.lit("symbols"), F.lit('""'), F.lit("ocr_text"), quoted("lang"))).alias("content"))


# --- traversals ----------------------------------------------------------------------------------------------------------


@query(
    "dependents_named",
    f"""with {_V}, {_R}, n as (select id from cur where kind = 'Repository'), x as (select r.t node_id, 'incoming' direction, r.kind, r.f other_id from currel r where r.t in (select id from n)
    union all select r.f, 'outgoing', r.kind, r.t from currel r where r.f in (select id from n) and r.f is distinct from r.t) select x.*, cur.name other_name from x left join cur on cur.id = x.other_id""",
)
def dependents_named(spark, folder):
    e = _engine(spark, folder)
    return e.dependents(e.current()[0].where("kind = 'Repository'"))


@query(
    "feeds_chain",
    f"""with recursive {_V}, {_R}, fi as (select id, f, t from live where lower(kind) = 'feedsinto'),
    roots as (select id from cur where kind = 'TransformNode' and id not in (select f from fi where f is not null)),
    walk as (select id root, id node, 0 hop from roots union select w.root, fi.f, w.hop + 1 from walk w join fi on fi.t = w.node where w.hop < 50 and (w.hop = 0 or w.node in (select id from cur))),
    m as (select root, node, min(hop) hop from walk group by 1, 2)
    select m.root root_id, m.node node_id, m.hop, min(fi.id) edge_id from m join fi on fi.f = m.node join m p on p.root = m.root and p.node = fi.t and p.hop = m.hop - 1 where m.hop > 0 and m.node in (select id from cur) group by 1, 2, 3""",
)
def feeds_chain(spark, folder):
    o, r = (cut(df) for df in _graph(spark, folder))
    fed = r.where((F.lower("kind") == "feedsinto") & graph.not_pending(r)).select(F.col("from").alias("id"))
    return graph.chain(o, r, o.where("kind = 'TransformNode'").select("id").join(fed, "id", "left_anti"))


# --- identity ------------------------------------------------------------------------------------------------------------

_FILE_NAMES = r"select file_id::varchar id, regexp_replace(regexp_extract(path, '([^/]*)\.[^./]*$', 1), '\d+$', '') as name, lower(regexp_extract(path, '\.([^./]*)$', 1)) kind from source_files where path is not null"


@query("identity_conflicts_files", f"with c as ({_FILE_NAMES}), n as (select regexp_replace({_NORM.format('name')}, '(( table| tbl| dim| fact)+)$', '') norm_name, kind from c) select norm_name, count(distinct kind) n_kinds, array_to_string(list_sort(list(distinct kind)), ',') kinds from n where norm_name <> '' group by 1 having count(distinct kind) > 1")
def identity_conflicts_files(spark, folder):
    p = F.col("path")
    f = table(spark, folder, "source_files").where("path is not null").select(F.col("file_id").cast("string").alias("id"), F.regexp_replace(F.regexp_extract(p, r"([^/]*)\.[^./]*$", 1), r"\d+$", "").alias("name"), F.lower(F.regexp_extract(p, r"\.([^./]*)$", 1)).alias("kind"))
    return identity.conflicts(f)


@query(
    "name_forms",
    f"""with {_V} select id, case when kind = 'Table' and not contains(name, '/') then string_split(name, '.')[-1] when kind in ('Issue', 'PullRequest') and regexp_extract(name, '^[^#]*#[^:]*?: (.*)$', 1) <> '' then regexp_extract(name, '^[^#]*#[^:]*?: (.*)$', 1) else name end comparable,
    regexp_replace({_NORM.format('name')}, '(( table| tbl| dim| fact)+)$', '') normalized, {_CROSS.format(_NORM.format("string_split(name, '.')[-1]"))} cross_system from cur where name is not null""",
)
def name_forms(spark, folder):
    n = F.col("name")
    return _graph(spark, folder)[0].where("name is not null").select("id", text.comparable_name(n, F.col("kind")).alias("comparable"), text.normalized_name(n).alias("normalized"), text.cross_system_name(n).alias("cross_system"))


_COLS = "cols as (select id, list_sort(list_distinct(list_transform(from_json(props['columns'], '[\"JSON\"]'), lambda x: lower(x->>'name')))) c from cur where props['columns'] is not null and json_array_length(props['columns']) > 0)"
_PAIRS = f"select distinct least(a, b) a, greatest(a, b) b from (select {_uuid_sql('a_id')} a, {_uuid_sql('b_id')} b from match_candidates where a_id is not null and b_id is not null) where a <> b"


def _candidate_pairs(spark, folder):
    m = table(spark, folder, "match_candidates").where("a_id is not null and b_id is not null").select(canonical_uuid("a_id").alias("a"), canonical_uuid("b_id").alias("b"), F.col("confidence").cast("double").alias("score")).where("a <> b")
    return m.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "score")


@query("structural_scores", f"with {_VP}, {_COLS}, p as ({_PAIRS}) select a left_id, b right_id, round(len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))), 6) score from p join cols x on x.id = p.a join cols y on y.id = p.b")
def structural_scores(spark, folder):
    """How alike the columns of the tables of each candidate pair are."""
    o = T.structured_objects(table(spark, folder, "objects")).where("columns is not null").select("id", "columns", "cells")
    p = _candidate_pairs(spark, folder).select("left_id", "right_id").distinct()
    return p.join(o.alias("a"), F.col("left_id") == F.col("a.id")).join(o.alias("b"), F.col("right_id") == F.col("b.id")).select("left_id", "right_id", F.round(identity.structural("a", "b"), 6).alias("score"))


@query(
    "type_families",
    f"""with {_VP}, t as (select lower(x->>'data_type') t from (select unnest(from_json(props['columns'], '["JSON"]')) x from cur where props['columns'] is not null))
    select t data_type, case when contains(t, 'int') then 'integer' when regexp_matches(t, 'char|text|string') then 'string' when regexp_matches(t, 'date|time') then 'datetime' when regexp_matches(t, 'numeric|decimal|float|double') then 'numeric' when contains(t, 'bool') then 'boolean' else t end family, count(*) n from t group by 1""",
)
def type_families(spark, folder):
    c = T.current_objects(table(spark, folder, "objects"), T.columns(F.col("props")).alias("columns")).select(F.explode("columns").alias("c")).select(F.lower("c.data_type").alias("data_type"))
    return c.groupBy("data_type").agg(F.count(F.lit(1)).alias("n")).select("data_type", text.type_family(F.col("data_type")).alias("family"), "n")


_LINKED = f"""
sure as (select least(a, b) l, greatest(a, b) r, max(c) score from (select {_uuid_sql('a_id')} a, {_uuid_sql('b_id')} b, confidence::double c from match_candidates where a_id is not null and b_id is not null and confidence >= 0.9::float and not isnan(confidence)) where a <> b group by 1, 2),
named as (select l, r, score, coalesce(x.name, '') = coalesce(y.name, '') same from sure left join cur x on x.id = l left join cur y on y.id = r),
two as (select l u, r v from sure union select r, l from sure),
walk as (select u id, u reached from two union select w.id, two.v from walk w join two on two.u = w.reached),
members as (select id, min(reached) canonical_id from walk group by 1),
judged as (select canonical_id, bool_and(same) exact, max(score) confidence from named join members on members.id = named.l group by 1)"""


def _linked(spark, folder):
    names = _graph(spark, folder)[0].select("id", "name")
    p = _candidate_pairs(spark, folder).where("score >= cast(0.9 as float) and not isnan(score)").groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    for side in ("left", "right"):
        p = p.join(names.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")), f"{side}_id", "left").fillna("", [f"{side}_name"])
    p = cut(p)
    return p, identity.merge_groups(p)


@query("candidate_groups", f"with recursive {_V}, {_LINKED} select id, m.canonical_id, exact from members m join judged j on j.canonical_id = m.canonical_id")
def candidate_groups(spark, folder):
    return _linked(spark, folder)[1]


@query("candidate_group_confidence", f"with recursive {_V}, {_LINKED} select j.canonical_id, count(*) n_members, any_value(exact) exact, any_value(round(confidence, 6)) confidence from members m join judged j on j.canonical_id = m.canonical_id group by 1")
def candidate_group_confidence(spark, folder):
    return identity.group_confidence(*_linked(spark, folder)).withColumn("confidence", F.round("confidence", 6))


@query("candidate_reviews", f"with recursive {_V}, {_LINKED} select m.canonical_id as \"from\", m.id as \"to\", 'SameAs' kind, 'unconfirmed' status, round(confidence, 6) confidence from members m join judged j on j.canonical_id = m.canonical_id where not exact and m.id <> m.canonical_id")
def candidate_reviews(spark, folder):
    return identity.review_links(*_linked(spark, folder)).withColumn("confidence", F.round("confidence", 6))


@query("review_decisions", f"with {_R} select id subject, case when id < '8' then 'Merged' else 'Modified' end kind from currel where lower(kind) = 'sameas'")
def review_decisions(spark, folder):
    r = _graph(spark, folder)[1]
    decisions = r.select("id", F.when(F.col("id") < "8", "confirmed").otherwise("rejected").alias("decision"))
    return identity.review(r, decisions)[1]


# --- compilation ---------------------------------------------------------------------------------------------------------


@query("graph_union", f"with {_V} select id, name, kind from cur union all select id, tech_name, 'Technology' from technologies")
def graph_union(spark, folder):
    return compile.union([_graph(spark, folder)[0].select("id", "name", "kind"), table(spark, folder, "technologies").select("id", F.col("tech_name").alias("name"), F.lit("Technology").alias("kind"))])


_MERGED = "to_one as (select id, canonical_id from members where id <> canonical_id)"


@query("merged_objects", f"with recursive {_V}, {_LINKED}, {_MERGED} select id, name from cur where id not in (select id from to_one)")
def merged_objects(spark, folder):
    o, r = _graph(spark, folder)
    return compile.apply_merges(o, r, _linked(spark, folder)[1])[0].select("id", "name")


@query(
    "merged_relationships",
    f"""with recursive {_V}, {_R}, {_LINKED}, {_MERGED}, moved as (select coalesce(a.canonical_id, f) f, coalesce(b.canonical_id, t) t, kind, created_at, currel.id from currel left join to_one a on a.id = f left join to_one b on b.id = t)
    select f as "from", t as "to", kind, min_by(id, struct_pack(c := created_at, i := id)) id from moved group by 1, 2, 3""",
)
def merged_relationships(spark, folder):
    o, r = _graph(spark, folder)
    return compile.apply_merges(o, r, _linked(spark, folder)[1])[1].select("from", "to", "kind", "id")


@query(
    "ckm_evidence",
    f"""with {_V}, ev as (select id, min(struct_pack(c := least(greatest(coalesce(confidence::double, 0), 0), 1), f := fragment)) v from evidence group by id),
    l as (select id o, unnest(evidence) e, generate_subscripts(evidence, 1) p from cur), j as (select o, e, p, v.c c, v.f f from l join ev on ev.id = l.e)
    select cur.id, coalesce(x.ids, '') evidence, x.f primary_description from cur left join (select o, string_agg(e, ',' order by c desc, p) ids, first(f order by c desc, p) f from j group by o) x on x.o = cur.id""",
)
def ckm_evidence(spark, folder):
    m = compile.canonical_model(_graph(spark, folder)[0], table(spark, folder, "evidence"))
    return m.select("id", F.coalesce(F.array_join(F.transform("evidence", lambda e: e["id"]), ","), F.lit("")).alias("evidence"), "primary_description")


@query(
    "rollup_neighbours",
    """with p as (select file_id::varchar id, file_id, repo, 'dir:' || array_to_string(list_slice(string_split(path, '/'), 1, 3), '/') g from source_files where path is not null),
    s as (select g, count(*) n from p group by g having count(*) >= 2), ins as (select id, g from p where g in (select g from s)),
    r as (select id f, lead(id) over (partition by repo order by file_id) t from p), x as (select a.g ga, b.g gb from r left join ins a on a.id = r.f left join ins b on b.id = r.t where r.t is not null and a.g is distinct from b.g),
    c as (select g, count(*) k from (select ga g from x where ga is not null union all select gb from x where gb is not null) group by g)
    select s.g group_key, s.n n_members, coalesce(c.k, 0) n_boundary from s left join c on c.g = s.g where (select count(*) from s) >= 2""",
)
def rollup_neighbours(spark, folder):
    """Files of one repository linked to the next by id, rolled up by three path components."""
    files = table(spark, folder, "source_files").where("path is not null").select(F.col("file_id").cast("string").alias("id"), "file_id", "repo", "path")
    links = files.withColumn("to", F.lead("id").over(Window.partitionBy("repo").orderBy("file_id"))).where("to is not null").select("id", F.col("id").alias("from"), "to")
    return compile.rollups(files.select("id", "path"), links)


# --- recovery and sources ------------------------------------------------------------------------------------------------

_ISSUES = "body || ' see https://github.com/x/y/issues/' || (doc_id % 50) || ' and #' || doc_id || ' Fixes #' || doc_id % 9"


@query(
    "issue_links",
    rf"""with i as (select doc_id number, {_ISSUES.replace('body', 'text')} body from documents where text is not null),
    b as (select number, list_distinct(list_transform(regexp_extract_all(lower(body), '(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?) #(\d{{1,9}})', 1), lambda x: x::bigint)) c,
      list_distinct(list_transform(list_concat(regexp_extract_all(body, '#(\d{{1,9}})', 1), regexp_extract_all(body, '(?i)github\.com/x/y/(?:issues|pull)/(\d{{1,9}})', 1)), lambda x: x::bigint)) m from i)
    select 'x/y' repo, number from_number, unnest(c) to_number, 'closes' kind from b union all select 'x/y', number, to_number, 'mentions' from (select number, unnest(list_filter(m, lambda x: not list_contains(c, x))) to_number from b) where to_number <> number""",
)
def issue_links(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select(F.lit("x/y").alias("repo"), F.col("doc_id").alias("number"), "doc_id", F.col("text").alias("body"))
    return recovery.issue_links(d.select("repo", "number", F.expr(_ISSUES).alias("body")))


@query("ownership", f"select distinct {_UUID5.format(chr(39) + 'event:' + chr(39) + ' || sha')} event_id, {_UUID5.format(chr(39) + 'contributor:' + chr(39) + ' || author_name')} person_id from (select distinct sha, author_name from commits where sha is not null and author_name in (select author_name from authors where n_commits >= 5))")
def ownership(spark, folder):
    return recovery.ownership(table(spark, folder, "commits"), table(spark, folder, "authors").where("n_commits >= 5").select("author_name"))


_PAGE_TABLE = "select doc_id::varchar id, case when doc_id % 4 = 0 then null else (doc_id // 4)::varchar end parent_id, 'title ' || doc_id % 400 title, coalesce(text, '') || ' content-title=\"title ' || (doc_id * 3) % 500 || '\" content-title=\"\"' body from documents"


@query(
    "page_links",
    f"""with p as ({_PAGE_TABLE}), t as (select title, min(id) to_id from p group by 1), n as (select id, unnest(regexp_extract_all(body, 'content-title="([^"]+)"', 1)) title from p)
    select parent_id from_id, id to_id, 'Contains' kind from p where parent_id is not null union select n.id, t.to_id, 'References' from n join t on t.title = n.title""",
)
def page_links(spark, folder):
    return recovery.page_links(table(spark, folder, "documents").selectExpr("cast(doc_id as string) id", "case when doc_id % 4 = 0 then null else cast(doc_id div 4 as string) end parent_id", "'title ' || doc_id % 400 title", "coalesce(text, '') || ' content-title=\"title ' || (doc_id * 3) % 500 || '\" content-title=\"\"' body"))


def _export(spark, folder):
    o, r = _graph(spark, folder)
    entities = o.select(F.col("id").alias("entity_id"), "kind", "name", F.lit("{}").alias("attrs"))
    return recovery.graph_export(entities, r.select(F.col("from").alias("src_entity_id"), F.col("to").alias("dst_entity_id"), F.col("evidence").alias("evidence_ids"), "id"))


@query("export_edges", f"with {_V}, {_R} select id, f src_entity_id, t dst_entity_id from currel where f in (select id from cur) and t in (select id from cur)")
def export_edges(spark, folder):
    return _export(spark, folder)[1].select("id", "src_entity_id", "dst_entity_id")


@query("export_diagnostics", f"with {_V}, {_R}, x as (select *, coalesce(f in (select id from cur), false) and coalesce(t in (select id from cur), false) inside from currel) select case when not inside then 'end outside batch' else 'no evidence' end diagnostic, count(*) n from x where not inside or len(evidence) = 0 group by 1")
def export_diagnostics(spark, folder):
    return _export(spark, folder)[2].groupBy("diagnostic").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_tables", """with c as (select 'repo ' || repo table_name, row_number() over (partition by repo order by file_id) as position, path column_name, 'text' data_type from source_files where repo is not null and path is not null)
    select table_name, '[' || string_agg('{"name":' || to_json(column_name) || ',"data_type":"text"}', ',' order by position) || ']' as columns from c group by 1""")
def catalog_tables(spark, folder):
    c = table(spark, folder, "source_files").where("repo is not null and path is not null").select(F.concat(F.lit("repo "), "repo").alias("table_name"), F.row_number().over(Window.partitionBy("repo").orderBy("file_id")).alias("position"), F.col("path").alias("column_name"), F.lit("text").alias("data_type"))
    return recovery.catalog_tables(c)


@query("repository_records", "with c as (select repo, author_name, count(distinct sha) n from commits where sha is not null and author_name is not null group by 1, 2) select r.repo, head_branch, array_to_string(remotes, ',') remotes, author_name, coalesce(n, 0) n_commits from repositories r left join c on c.repo = r.repo")
def repository_records(spark, folder):
    return readers.repository_records(table(spark, folder, "commits"), table(spark, folder, "repositories"))


@query("changed_files", "with f as (select file_id, path, sha256(source) h, observed_at from source_files where source is not null and path is not null) select file_id from f where not exists (select 1 from f k where k.path = f.path and k.h = f.h and k.observed_at < timestamp '2025-06-01')")
def changed_files(spark, folder):
    f = table(spark, folder, "source_files").where("source is not null and path is not null").select("file_id", "path", F.sha2("source", 256).alias("sha256"), "observed_at")
    return readers.changed_files(f, f.where("observed_at < timestamp_ntz '2025-06-01 00:00:00'")).select("file_id")


_HTML = "'<html><head><script>var x = 1;</script></head><body><h1>' || repo || '</h1><p>' || path || '</p><p>a &amp; b</p></body></html>'"


@query("html_texts", "select file_id, repo || chr(10) || path || chr(10) || 'a & b' body from source_files where repo is not null and path is not null")
def html_texts(spark, folder):
    return table(spark, folder, "source_files").where("repo is not null and path is not null").select("file_id", readers.html_texts(F.expr(_HTML)).alias("body"))


_MAIL = "concat_ws(chr(10), 'From: a@b.test', 'Subject: ' || file_id, '', path)"


@query("email_texts", f"select file_id, {_MAIL} body from source_files where path is not null")
def email_texts(spark, folder):
    return table(spark, folder, "source_files").where("path is not null").select("file_id", readers.email_texts(F.expr(_MAIL)).alias("body"))


@query("git_logs", "select sha, repo, len(list_filter(files_changed, lambda f: f is not null)) n_files, len(list_filter(files_changed, lambda f: f is not null)) * 2 insertions from commits where sha is not null and repo is not null and files_changed is not null")
def git_logs(spark, folder):
    c = table(spark, folder, "commits").where("sha is not null and repo is not null and files_changed is not null")
    log = "chr(30) || concat_ws(chr(31), sha, 'A', 'a@b', '2024-01-01', 'what was done') || chr(10) || array_join(transform(filter(files_changed, f -> f is not null), f -> '2' || chr(9) || '-' || chr(9) || f), chr(10))"
    return readers.git_logs(c.select("repo", F.expr(log).alias("log"))).select("sha", "repo", F.size("files_changed").cast("bigint").alias("n_files"), "insertions")


_YAML = "concat_ws(chr(10), 'on: [push, schedule]', 'jobs:', '  build:', '    steps:', '      - run: make ' || file_id, '      - uses: tool', '  empty: {}', '')"


@query("ci_pipelines", r"select path, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') as name, 'push,schedule' triggers, job, case job when 'build' then 'make ' || file_id || ',tool' else '' end steps from source_files, (values ('build'), ('empty')) j(job) where path is not null")
def ci_pipelines(spark, folder):
    p = recovery.pipelines(table(spark, folder, "source_files").where("path is not null").select("path", F.expr(_YAML).alias("text")))
    return p.select("path", "name", F.array_join("triggers", ",").alias("triggers"), "job", F.array_join("steps", ",").alias("steps"))


_SECRET_PATHS = "path || case file_id % 8 when 0 then '/.env' when 1 then '/server.pem' when 2 then '/id_rsa.pub' when 3 then '/credentials.json' when 4 then '/env' when 5 then '/.env.local' else '' end"


@query("secret_paths_planted", f"select file_id from (select file_id, {_SECRET_PATHS} p from source_files where path is not null) where regexp_matches(regexp_extract(p, '[^/]*$'), '^(\\.env|\\.env\\..*|.*\\.pem|.*\\.key|.*\\.pfx|.*\\.p12|id_rsa|id_rsa\\..*|id_ed25519|id_ed25519\\..*|.*\\.ppk|credentials|credentials\\.json|\\.npmrc|\\.netrc|\\.pgpass|.*\\.jks|.*\\.keystore)$')")
def secret_paths_planted(spark, folder):
    return table(spark, folder, "source_files").where("path is not null").select("file_id", F.expr(_SECRET_PATHS).alias("path")).where(text.is_secret_file(F.col("path"))).select("file_id")


_BLOCKS = r"blocks as (select doc_id, unnest(regexp_extract_all(text, '(?s)```sql\n(.*?)```', 1)) blk from documents where contains(text, 'CREATE TABLE'))"


@query("sql_preprocessed", rf"with {_BLOCKS} select doc_id, md5(string_agg(blk, '') || ' CHECK (x > 0)  ''NOT VALID''') cleaned from (select * from blocks) group by 1")
def sql_preprocessed(spark, folder):
    """SQL blocks as a dialect's rules leave them, with text in quotes left alone."""
    @F.pandas_udf("string")
    def cleaned(sql: pd.Series) -> pd.Series:
        return pd.Series([recovery.preprocess(s, recovery.resolve_dialect([("*.pg.sql", "postgres")], "generic", "a.pg.sql")) for s in sql])

    d = table(spark, folder, "documents").where("text like '%CREATE TABLE%'").select("doc_id", F.concat(F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)```sql\n(.*?)```"), F.lit(1)), ""), F.lit(" CHECK (x > 0) NOT VALID 'NOT VALID'")).alias("sql"))
    return d.where("sql <> ' CHECK (x > 0) NOT VALID ''NOT VALID'''").select("doc_id", F.md5(cleaned("sql")).alias("cleaned"))


@query("text_forms", r"select file_id, trim(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '_') snake, trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') kebab, trim(regexp_replace('  ' || replace(path, '/', '   ') || chr(9), '\s+', ' ', 'g')) concept, regexp_replace(path, '/[^/]*$', '') || '/x/y' lexical from source_files where contains(path, '/')")
def text_forms(spark, folder):
    p = F.col("path")
    return table(spark, folder, "source_files").where("path like '%/%'").select("file_id", text.snake_slug(p).alias("snake"), text.kebab_slug(p).alias("kebab"), text.concept(F.concat(F.lit("  "), F.replace(p, F.lit("/"), F.lit("   ")), F.lit("\t"))).alias("concept"), text.lexical_path(F.concat(p, F.lit("/../x/./y"))).alias("lexical"))


@query("json_attributes", f"select {_uuid_sql('id')} id, coalesce(json_extract_string(payload, '$.round'), '') round from kir_events")
def json_attributes(spark, folder):
    return table(spark, folder, "kir_events").select(canonical_uuid("id").alias("id"), F.coalesce(text.json_attributes(F.col("payload"))["round"], F.lit("")).alias("round"))


# --- transformations -----------------------------------------------------------------------------------------------------

_SCRIPT = """CREATE VIEW gold.order_summary AS SELECT c.id, o.amount * c.tax_rate AS total_with_tax FROM dbo.cust_mstr c JOIN dbo.order_mstr o ON c.id = o.customer_id WHERE c.status = 'active';
SELECT region, SUM(amount) AS total FROM sales GROUP BY region HAVING SUM(amount) > 10 ORDER BY total LIMIT 3;
SELECT (1 + FROM x"""
_EXPECTED = [
    (0, 0, "Source", "dbo.cust_mstr"), (0, 1, "Source", "dbo.order_mstr"), (0, 2, "Join", "inner c.id=o.customer_id"), (0, 3, "Filter", "(c.status = 'active')"), (0, 4, "Calculate", "total_with_tax = (o.amount * c.tax_rate)"), (0, 5, "Sink", "gold.order_summary"),
    (1, 0, "Source", "sales"), (1, 1, "Aggregate", "region | sum(amount)"), (1, 2, "Unmapped", "LIMIT is not modelled"), (1, 3, "Unmapped", "ORDER BY is not modelled"), (1, 4, "Unmapped", "HAVING is not modelled"), (1, 5, "Sink", "result"), (2, 0, "Unmapped", "does not parse"),
]


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "null" if v is None else "'{}'".format(v.replace("'", "''")) if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names})"


@query("ir_nodes", _values(_EXPECTED, "graph, idx, node_type, shown"))
def ir_nodes(spark, folder):
    """Nodes of a script with a view, clauses that are not modelled and a statement that does not parse."""
    rows = [(g, i, n.kind, transform.comparable(n).split(":")[0]) for g, graph_ in enumerate(transform.from_sql(spark, _SCRIPT)) for i, n in enumerate(graph_.nodes)]
    return spark.createDataFrame(rows, "graph int, idx int, node_type string, shown string")


_MORE = {
    "CREATE PROCEDURE p() AS BEGIN SELECT a FROM x WHERE a > 1; IF a THEN UPDATE y SET b = 1; END IF; INSERT INTO z SELECT c FROM w; END": [("Source", "x"), ("Filter", "(a > 1)"), ("Sink", "result"), ("Unmapped", "routine statement"), ("Unmapped", "routine statement"), ("Source", "w"), ("Sink", "z")],
    "CREATE FUNCTION f() RETURNS TABLE AS $$ SELECT a FROM x; SELECT b FROM y $$": [("Source", "x"), ("Sink", "result"), ("Source", "y"), ("Sink", "result")],
    "SELECT o.k FROM o LEFT SEMI JOIN c USING (k, l)": [("Source", "o"), ("Source", "c"), ("Join", "semi k=k,l=l"), ("Sink", "result")],
    "SELECT x FROM o NATURAL JOIN c": [("Source", "o"), ("Source", "c"), ("Unmapped", "natural join"), ("Sink", "result")],
    "SELECT a.x FROM a, b WHERE a.i = b.i": [("Source", "a"), ("Source", "b"), ("Join", "cross "), ("Filter", "(a.i = b.i)"), ("Sink", "result")],
    "SELECT SUM(x) / 2 AS h FROM t GROUP BY g": [("Source", "t"), ("Aggregate", "g | "), ("Unmapped", "expression over aggregates"), ("Sink", "result")],
    "SELECT x FROM (SELECT x FROM t) d": [("Unmapped", "derived table"), ("Sink", "result")],
    "SELECT 1 UNION ALL SELECT 2": [("Unmapped", "query is not modelled"), ("Sink", "result")],
}


@query("ir_constructs", _values([(q, i, *n) for q, ns in _MORE.items() for i, n in enumerate(ns)], "statement, idx, node_type, shown"))
def ir_constructs(spark, folder):
    """Routines, joins of every kind, comma lists and what is not modelled."""
    rows = [(q, i, n.kind, transform.comparable(n)) for q in _MORE for g in [transform.from_sql(spark, q)] for i, n in enumerate([n for x in g for n in x.nodes])]
    return spark.createDataFrame(rows, "statement string, idx int, node_type string, shown string")


_CHAIN = 'df = spark.table("a").filter("x > 1").join(spark.table("b"), "id", "left").groupBy("k").agg(F.sum("v").alias("t")).withColumn("u", "t + 1")\ndf.write.saveAsTable("c")\nspark.sql("select 1")'


@query("ir_python_chain", _values([(0, 0, "Source", "a"), (0, 1, "Filter", "x > 1"), (0, 2, "Source", "b"), (0, 3, "Join", "left id=id"), (0, 4, "Aggregate", "k | sum(v)"), (0, 5, "Calculate", "u = t + 1"), (1, 0, "Unmapped", "spark.sql text")], "graph, idx, node_type, shown"))
def ir_python_chain(spark, folder):
    rows = [(g, i, n.kind, transform.comparable(n)) for g, x in enumerate(transform.from_python(_CHAIN)) for i, n in enumerate(x.nodes)]
    return spark.createDataFrame(rows, "graph int, idx int, node_type string, shown string")


def _executed(name: str, sql: str, names: list[str]) -> None:
    def f(spark, folder):
        return transform.execute(transform.from_sql(spark, sql)[0], {n: table(spark, folder, n) for n in names})["result"]

    query(name, sql)(f)


_executed("ir_full_join", "SELECT n.n_name AS nation, r.r_name AS region FROM nation n FULL JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 12", ["nation", "region"])
_executed("ir_right_join", "SELECT n.n_nationkey AS nation, s.s_suppkey AS supplier FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_nationkey > 3", ["nation", "supplier"])
_executed("ir_comma_join", "SELECT c.c_custkey AS customer, n.n_name AS nation FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 0", ["customer", "nation"])


@query("ir_using_join", "select event_id, n from events join (select user_id, count(*) n from events group by user_id) x using (user_id)")
def ir_using_join(spark, folder):
    e = table(spark, folder, "events")
    g = transform.from_sql(spark, "SELECT event_id, n FROM events JOIN users USING (user_id)")[0]
    return transform.execute(g, {"events": e, "users": e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))})["result"]


@query("ir_coverage", "select graph, coverage::double coverage from (values (0, 100), (1, 50), (2, 0)) v(graph, coverage)")
def ir_coverage(spark, folder):
    return spark.createDataFrame([(g, transform.coverage(x)) for g, x in enumerate(transform.from_sql(spark, _SCRIPT))], "graph int, coverage double")


@query("ir_repaired", _values([("a",), ("b",), ("c",)], "source"))
def ir_repaired(spark, folder):
    """Sources of a script whose statements nothing parts, and one of which does not parse."""
    graphs = transform.from_sql_repaired(spark, "SELECT x FROM a\nSELECT y FROM b\nWHERE y > 1\nSELECT 1 +\nSELECT z FROM c")
    return spark.createDataFrame([(n.args["name"],) for g in graphs for n in g.nodes if n.kind == "Source"], "source string")


@query("ir_dbt", _values([("models/aggregate_2.sql", "select n, sum(v) as t from {{ ref('filter_1') }} group by n\n"), ("models/filter_1.sql", "select * from {{ source('raw', 's') }} where (v > 1)\n"), ("models/result_3.sql", "select n, t from {{ ref('aggregate_2') }}\n"), ("models/schema.yml", "version: 2\nsources:\n  - name: raw\n    tables:\n      - name: s\nmodels:\n  - name: aggregate_2\n  - name: filter_1\n  - name: result_3\n")], "file, body"))
def ir_dbt(spark, folder):
    files = transform.to_dbt(transform.from_sql(spark, "SELECT n, SUM(v) AS t FROM s WHERE v > 1 GROUP BY n")[0])
    return spark.createDataFrame(sorted(files.items()), "file string, body string")


_KETTLE = """<transformation><step><name>in</name><type>TableInput</type><table>src.a</table></step><step><name>f</name><type>FilterRows</type><compare><condition><leftvalue>x</leftvalue><function>=</function><rightvalue>1</rightvalue></condition></compare></step>
<step><name>out</name><type>TableOutput</type><table>dst.b</table></step><step><name>odd</name><type>Script</type></step><order><hop><from>in</from><to>f</to></hop><hop><from>f</from><to>out</to></hop></order></transformation>"""


@query("ir_kettle", _values([("Source", "src.a", None), ("Filter", "x = 1", "Source"), ("Sink", "dst.b", "Filter"), ("Unmapped", "step Script", None)], "node_type, shown, fed_by"))
def ir_kettle(spark, folder):
    g = transform.from_kettle(_KETTLE)
    rows = [(n.kind, transform.comparable(n), g.nodes[g.inputs(i)[0]].kind if g.inputs(i) else None) for i, n in enumerate(g.nodes)]
    return spark.createDataFrame(rows, "node_type string, shown string, fed_by string")


@query("ir_lowered", "select {} as \"from\", {} as \"to\", 'FeedsInto' kind from (values (0, 1), (1, 2), (2, 3)) v(a, b)".format(*[_UUID5.format(f"'transform:sql:s.sql:node:' || {c}") for c in "ab"]))
def ir_lowered(spark, folder):
    g = transform.from_sql(spark, "SELECT n, SUM(v) AS t FROM s WHERE v > 1 GROUP BY n")[0]
    return transform.lower(spark, [("s.sql", "sql", g)])[1]


_NODE_TYPE = "case {} % 7 when 0 then 'Source' when 1 then 'Filter' when 2 then 'Join' when 3 then 'Aggregate' when 4 then 'Calculate' when 5 then 'Sink' else 'Unmapped' end".format("instr('0123456789abcdef', substring(id, 1, 1))")


@query(
    "explained_nodes",
    f"""with {_V}, n as (select id, name, evidence, {_NODE_TYPE} t from cur where kind = 'TransformNode'), ev as (select id, min(fragment) f from evidence group by id),
    u as (select id, unnest(evidence) e, generate_subscripts(evidence, 1) p from n), x as (select u.id, min_by(ev.f, p) f from u join ev on ev.id = u.e group by 1)
    select n.id, coalesce(name, '?') || ' ' || case t when 'Source' then 'reads data' when 'Filter' then 'keeps some rows' when 'Join' then 'joins its inputs' when 'Aggregate' then 'groups and aggregates' when 'Calculate' then 'computes a column' when 'Sink' then 'writes data' else 'is not understood' end || '.' sentence, x.f first_fragment from n left join x on x.id = n.id""",
)
def explained_nodes(spark, folder):
    n = _graph(spark, folder)[0].where("kind = 'TransformNode'").select("id", "name", "evidence", F.expr(_NODE_TYPE).alias("node_type"))
    return transform.explain_nodes(n, table(spark, folder, "evidence"))


# --- documentation -------------------------------------------------------------------------------------------------------

_PAGE_ROWS = """efirst as (select id, min(fragment) f from evidence group by id), eu as (select id, unnest(evidence) e, generate_subscripts(evidence, 1) p from currel),
    ex as (select eu.id, min_by(efirst.f, p) f from eu join efirst on efirst.id = eu.e group by 1),
    prow as (select r.f object_id, 'out' direction, r.kind, r.t other_id, ex.f first_fragment from currel r left join ex on ex.id = r.id union all select r.t, 'in', r.kind, r.f, ex.f from currel r left join ex on ex.id = r.id)"""


@query("page_rows", f"with {_V}, {_R}, {_PAGE_ROWS} select * from prow")
def page_rows(spark, folder):
    return docs.page_rows(_graph(spark, folder)[1], table(spark, folder, "evidence"))


@query(
    "pages",
    f"""with {_V}, {_R}, {_PAGE_ROWS}, {_PAGES}, lines as (select object_id, '- ' || direction || ' ' || p.kind || ': ' || coalesce(cur.name, other_id, '?') || coalesce(' (' || first_fragment || ')', '') line from prow p left join cur on cur.id = p.other_id where object_id is not null),
    bodies as (select object_id, string_agg(line, chr(10) order by line) body from lines where line is not null group by 1)
    select cur.id, page, md5('# ' || coalesce(name, '?') || chr(10) || chr(10) || 'Kind: ' || coalesce(kind, '?') || chr(10) || chr(10) || coalesce(body, 'No relationships.')) text_md5 from cur join paged on paged.id = cur.id left join bodies on bodies.object_id = cur.id""",
)
def pages(spark, folder):
    return _engine(spark, folder).pages().select("id", "page", F.md5("text").alias("text_md5"))


_ORIGINS = "steps as (select id, regexp_extract(name, '^([^-]*)', 1) origin from cur where kind = 'TransformNode')"


@query("data_flow", f"with {_V}, {_R}, {_ORIGINS}, s as (select origin, count(*) n from steps group by 1), e as (select a.origin, f, t from currel r join steps a on a.id = r.f join steps b on b.id = r.t where lower(kind) = 'feedsinto' and a.origin = b.origin) select s.origin, f as \"from\", t as \"to\", n n_steps from s left join e on e.origin = s.origin")
def data_flow(spark, folder):
    o, r = _graph(spark, folder)
    return docs.data_flow(o.withColumn("name", F.concat(F.regexp_extract("name", "^([^-]*)", 1), F.lit(":"), "id")), r)


@query("call_sequences", f"with {_V}, {_R}, h as (select t, min(cur.name) file from currel r join cur on cur.id = r.f and cur.kind = 'File' where lower(r.kind) = 'contains' group by 1) select coalesce(file, '(file unknown)') module, f as \"from\", r.t as \"to\" from currel r left join h on h.t = r.f where lower(r.kind) = 'calls'")
def call_sequences(spark, folder):
    return docs.call_sequences(*_graph(spark, folder))


@query("kind_graph", f"with {_V}, {_R} select distinct a.name from_name, lower(r.kind) kind, b.name to_name from currel r join cur a on a.id = r.f and a.kind = 'Table' join cur b on b.id = r.t and b.kind = 'Table' where lower(r.kind) <> 'feedsinto'")
def kind_graph(spark, folder):
    return docs.kind_graph(*_graph(spark, folder), "Table")


@query("module_listing", f"with {_V}, {_R} select f module_id, array_to_string(list_sort(list(distinct cur.name)), ', ') symbols from currel r join cur on cur.id = r.t where lower(r.kind) = 'contains' and cur.kind in ('RustSymbol', 'PythonSymbol') and f is not null group by 1")
def module_listing(spark, folder):
    o, r = _graph(spark, folder)
    return docs.module_listing(o, r.where("from is not null"), ["RustSymbol", "PythonSymbol"])


# --- simulation and context ----------------------------------------------------------------------------------------------

_AGENTS = "select c_custkey::varchar agent_id, c_custkey k, c_nationkey from customer"
_OBSERVED = "obs as (select a.agent_id, m.n_name as name from ag a join nation n on n.n_nationkey = a.c_nationkey join nation m on m.n_regionkey = n.n_regionkey)"
_VERB = "case k % 3 when 0 then 'support:' when 1 then 'oppose:' else 'watch:' end"


def _agents(spark, folder):
    a = table(spark, folder, "customer").selectExpr("cast(c_custkey as string) agent_id", "c_custkey k", "c_nationkey")
    n = table(spark, folder, "nation")
    mine = a.join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    observed = mine.join(n.select("n_regionkey", F.col("n_name").alias("name")), "n_regionkey").select("agent_id", "name")
    of = lambda key, name: a.withColumn("_n", F.expr(key)).join(n.select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias(name)), "_n").drop("_n")
    return a, observed, of


@query(
    "decisions",
    f"""with ag as ({_AGENTS}), {_OBSERVED}, g as (select agent_id, 0 p, {_VERB} || n_name goal from ag join nation on n_nationkey = k * 7 % 25 union all select agent_id, 1, 'support:' || n_name from ag join nation on n_nationkey = k % 25),
    h as (select g.agent_id, min(struct_pack(p := p, v := split_part(goal, ':', 1), n := obs.name)) m from g join obs on obs.agent_id = g.agent_id and obs.name = split_part(goal, ':', 2) where split_part(goal, ':', 1) in ('support', 'oppose') group by 1)
    select ag.agent_id, case when m is null then 'DoNothing' when m.v = 'support' then 'Support' else 'Oppose' end action, m.n target, case when m is null then 0.5 else 0.8 end::double confidence from ag left join h on h.agent_id = ag.agent_id""",
)
def decisions(spark, folder):
    _, observed, of = _agents(spark, folder)
    goals = of("k * 7 % 25", "n").select("agent_id", F.lit(0).alias("position"), F.concat(F.expr(_VERB), "n").alias("goal")).unionByName(of("k % 25", "n").select("agent_id", F.lit(1).alias("position"), F.concat(F.lit("support:"), "n").alias("goal")))
    return simulation.decide(goals, observed)


_ACTION = "case k % 3 when 0 then 'FormAlliance' when 1 then 'Support' else 'DoNothing' end"


@query(
    "valid_actions",
    f"""with ag as ({_AGENTS}), {_OBSERVED}, ac as (select agent_id, k, {_ACTION} action, n_name target from ag join nation on n_nationkey = k * 7 % 25)
    select ac.agent_id, action, target, action = 'DoNothing' or (obs.name is not null and (action <> 'FormAlliance' or k % 2 = 0)) valid from ac left join obs on obs.agent_id = ac.agent_id and obs.name = ac.target""",
)
def valid_actions(spark, folder):
    _, observed, of = _agents(spark, folder)
    actions = of("k * 7 % 25", "target")
    trust = actions.select("agent_id", "target", F.expr("case when k % 2 = 0 then 0.5D else 0.3D end").alias("value"))
    return simulation.validate(actions.select("agent_id", F.expr(_ACTION).alias("action"), "target"), observed.withColumnRenamed("name", "target"), trust)


@query("trust_gained", f"with ag as ({_AGENTS}), t as (select agent_id, n_name target, k % 11 / 10.0 v from ag join nation on n_nationkey = k * 7 % 25), g as (select agent_id, n_name target from ag join nation on n_nationkey = k % 25 where k % 2 = 0) select coalesce(t.agent_id, g.agent_id) agent_id, coalesce(t.target, g.target) target, round(least(coalesce(v::double, 0) + case when g.agent_id is null then 0 else 0.2 end, 1), 6)::double as value from t full join g on g.agent_id = t.agent_id and g.target = t.target")
def trust_gained(spark, folder):
    _, _, of = _agents(spark, folder)
    return simulation.bump_trust(of("k * 7 % 25", "target").select("agent_id", "target", F.expr("k % 11 / 10D").alias("value")), of("k % 25", "target").where("k % 2 = 0").select("agent_id", "target"))


_SEEN = "select event_id, (user_id % 25)::varchar agent_id, ((user_id + 1) % 25)::varchar target, case event_id % 3 when 0 then 'private' when 1 then 'self' else 'public' end visibility from events"


@query("public_fanout", f"with a as ({_SEEN}), f as (select distinct event_id, observer_id from (select event_id, case when visibility = 'public' then '*' else agent_id end observer_id from a union all select event_id, target from a where visibility = 'private')) select observer_id, count(*) n_events from f group by 1")
def public_fanout(spark, folder):
    """How many events each agent sees of its own, and the public ones as one class."""
    a = table(spark, folder, "events").selectExpr("event_id", "cast(user_id % 25 as string) agent_id", "cast((user_id + 1) % 25 as string) target", "case event_id % 3 when 0 then 'private' when 1 then 'self' else 'public' end visibility")
    return simulation.observers(a).groupBy("observer_id").agg(F.count(F.lit(1)).alias("n_events"))


@query("observed_events", f"with a as ({_SEEN}), f as (select distinct event_id, observer_id from (select event_id, agent_id observer_id from a where visibility <> 'public' union all select event_id, target from a where visibility = 'private' union all select event_id, g.agent_id from a join (select distinct agent_id from a) g on a.visibility = 'public')) select observer_id agent_id, count(*) n_events from f where observer_id in (select agent_id from a) group by 1")
def observed_events(spark, folder):
    a = table(spark, folder, "events").selectExpr("event_id", "cast(user_id % 25 as string) agent_id", "cast((user_id + 1) % 25 as string) target", "case event_id % 3 when 0 then 'private' when 1 then 'self' else 'public' end visibility")
    return simulation.observed_by(simulation.observers(a), a).groupBy("agent_id").agg(F.count(F.lit(1)).alias("n_events"))


@query("follows_once", f"with {_R}, k as (select distinct f, t from rels where lower(kind) = 'references'), m as (select distinct f, t from rels where lower(kind) in ('references', 'calls')) select f as \"from\", t as \"to\" from k union all select f, t from m where not exists (select 1 from k where k.f = m.f and k.t = m.t)")
def follows_once(spark, folder):
    r = T.relationship_rows(table(spark, folder, "relationships"))
    of = lambda *kinds: r.where(F.lower("kind").isin(*kinds)).select("from", "to")
    return simulation.add_once(of("references").distinct(), of("references", "calls"), ["from", "to"])


@query("replayed_round", f"with {_V}, ev as (select min(occurred_at) moment from kir_events where try_cast(json_extract_string(payload, '$.round') as int) = 5) select id, name, kind from (select *, row_number() over (partition by id order by created_at desc, sig desc) rn from versions where created_at <= (select moment from ev)) where rn = 1")
def replayed_round(spark, folder):
    """Objects as they were going into round 5."""
    e = table(spark, folder, "kir_events")
    return simulation.replay(e, T.object_versions(table(spark, folder, "objects")), 5).select("id", "name", "kind")


@query("cited", "select doc_id::varchar answer_id, 0 as position, doc_id::varchar citation from documents where text is not null")
def cited(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    answers = d.where("text is not null").select(F.col("id").alias("answer_id"), F.concat("text", F.lit(' {"citations": ["'), "id", F.lit('", "nothing", "'), "id", F.lit('"]} Yes.')).alias("content"))
    return context.cited(answers, d)


_GATE = [("SELECT 1", "SELECT 1 LIMIT 1000"), ("select a from b limit 5;", "select a from b limit 5"), ("SELECT 1; SELECT 2", None), ("DROP TABLE x", None), ("INSERT INTO x SELECT 1", None), ("with a as (select 1) select * from a", "with a as (select 1) select * from a LIMIT 1000"), ("-- only a remark", None), ("select ';' as x", "select ';' as x LIMIT 1000")]


@query("query_gate", _values(_GATE, "statement, allowed"))
def query_gate(spark, folder):
    def gate(s):
        try:
            return context.select_only(spark, s)
        except ValueError:
            return None

    return spark.createDataFrame([(s, gate(s)) for s, _ in _GATE], "statement string, allowed string")


@query("schema_lines", f"with {_VP}, t as (select name, x, i from (select name, unnest(from_json(props['columns'], '[\"JSON\"]')) x, generate_subscripts(from_json(props['columns'], '[\"JSON\"]'), 1) i, id from cur where kind = 'Table' and props['columns'] is not null)), l as (select id, name || '(' || string_agg((x->>'name') || ' ' || (x->>'data_type'), ', ' order by i) || ')' line from (select name, unnest(from_json(props['columns'], '[\"JSON\"]')) x, generate_subscripts(from_json(props['columns'], '[\"JSON\"]'), 1) i, id from cur where kind = 'Table' and props['columns'] is not null) group by id, name) select line from l where line is not null")
def schema_lines(spark, folder):
    o = T.current_objects(table(spark, folder, "objects"), T.columns(F.col("props")).alias("columns"))
    return context.schema_rows(o.where("kind = 'Table' and size(columns) > 0 and name is not null").select(F.col("name").alias("table_name"), F.lit("any").alias("source_system"), "columns"))
