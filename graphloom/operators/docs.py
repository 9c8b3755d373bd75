"""Aggregates for documentation, and texts rendered from small results on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def kind_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("kind").agg(F.count_distinct("id").alias("n_objects"))


def contributor_rank(people: DataFrame) -> DataFrame:
    """(author_name, commit_count): more commits first, then by name; no count counts as 0. A range sort, no single task."""
    return people.groupBy("author_name").agg(F.coalesce(F.max("commit_count"), F.lit(0)).alias("commit_count")).orderBy(F.desc("commit_count"), "author_name")


def er_edges(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(from, to): distinct foreign keys between two tables."""
    tables = objects.where("kind = 'Table'").select("id").distinct()
    fk = relationships.where(F.lower("kind") == "foreignkey").select("from", "to").distinct()
    return fk.join(tables.withColumnRenamed("id", "from"), "from", "left_semi").join(tables.withColumnRenamed("id", "to"), "to", "left_semi").select("from", "to")


def page_model(relationships: DataFrame) -> DataFrame:
    """(object_id, kind, direction, n_relationships): how each object's page groups its relationships."""
    out = relationships.select(F.col("from").alias("object_id"), "kind", F.lit("out").alias("direction"))
    into = relationships.select(F.col("to").alias("object_id"), "kind", F.lit("in").alias("direction"))
    return out.unionByName(into).groupBy("object_id", "kind", "direction").agg(F.count(F.lit(1)).alias("n_relationships"))


def architecture(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(from_kind, kind, to_kind, n): relationships between kinds of objects, data flow left out."""
    kinds = objects.groupBy("id").agg(F.min("kind").alias("k"))
    r = relationships.where(F.lower("kind") != "feedsinto").select("from", "to", F.lower("kind").alias("kind"))
    r = r.join(kinds.select(F.col("id").alias("from"), F.col("k").alias("from_kind")), "from").join(kinds.select(F.col("id").alias("to"), F.col("k").alias("to_kind")), "to")
    return r.groupBy("from_kind", "kind", "to_kind").agg(F.count(F.lit(1)).alias("n"))


def module_listing(objects: DataFrame, relationships: DataFrame, symbol_kinds: list[str]) -> DataFrame:
    """(module_id, symbols): names of symbols by the module that contains them, sorted."""
    symbols = objects.where(F.col("kind").isin(symbol_kinds)).select(F.col("id").alias("to"), "name")
    held = relationships.where(F.lower("kind") == "contains").select("from", "to").distinct()
    return held.join(symbols, "to").groupBy(F.col("from").alias("module_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("symbols"))


def page_paths(objects: DataFrame, extension: str = "md") -> DataFrame:
    """(id, page): a path by slug in a folder of its first two letters; after the first by id, equal slugs get eight letters of their id."""
    slug = F.when(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "") == "", "x").otherwise(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    rows = objects.groupBy("id").agg(F.min("name").alias("name")).select("id", F.coalesce(slug, F.lit("x")).alias("slug"))
    first = rows.groupBy("slug").agg(F.min("id").alias("first"))
    name = F.when(F.col("id") == F.col("first"), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.substring("id", 1, 8)))
    return rows.join(first, "slug").select("id", F.concat(F.substring("slug", 1, 2), F.lit("/"), name, F.lit(f".{extension}")).alias("page"))


def mermaid(edges: list[tuple[str, str, str]], kind: str = "graph TD") -> str:
    """A diagram of (from, label, to)."""
    ids: dict[str, str] = {}
    node = lambda n: ids.setdefault(n, f"n{len(ids)}")
    lines = [f'    {node(a)}["{a}"] -->|{label}| {node(b)}["{b}"]' for a, label, b in edges]
    return "\n".join([kind, *lines]) + "\n"


def er_diagram(tables: dict[str, list[tuple[str, str]]], keys: list[tuple[str, str]]) -> str:
    """An entity diagram of tables (columns and types) and their keys (from, to)."""
    out = ["erDiagram"]
    for t in sorted(tables):
        out += [f"    {t} {{", *[f"        {(k or 'unknown').split('(')[0].replace(' ', '_')} {c}" for c, k in tables[t]], "    }"]
    return "\n".join(out + [f"    {b} ||--o{{ {a} : references" for a, b in sorted(set(keys))]) + "\n"


def readme(counts: list[tuple[str, int]]) -> str:
    return "\n".join(["# Overview", "", "| kind | objects |", "|---|---|", *[f"| {k} | {n} |" for k, n in sorted(counts)]]) + "\n"


def page_rows(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """(object_id, direction, kind, other_id, first_fragment): the lines of each object's page, a relationship with the first evidence of its list that exists."""
    text = evidence.groupBy("id").agg(F.min("fragment").alias("fragment")).select(F.col("id").alias("_e"), "fragment")
    listed = relationships.select("id", F.posexplode("evidence").alias("_p", "_e")).join(text, "_e").groupBy("id").agg(F.min_by("fragment", "_p").alias("first_fragment"))
    r = relationships.select("id", "kind", "from", "to").join(listed, "id", "left")
    side = lambda own, other, d: r.select(F.col(own).alias("object_id"), F.lit(d).alias("direction"), "kind", F.col(other).alias("other_id"), "first_fragment")
    return side("from", "to", "out").unionByName(side("to", "from", "in"))


def pages(objects: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, page, text): each object's page in Markdown, its relationships by direction, kind and other name, at a path of its own."""
    names = objects.groupBy("id").agg(F.min("name").alias("other_name")).withColumnRenamed("id", "other_id")
    rows = page_rows(relationships, evidence).join(names, "other_id", "left")
    line = F.concat(F.lit("- "), "direction", F.lit(" "), "kind", F.lit(": "), F.coalesce("other_name", "other_id", F.lit("?")), F.coalesce(F.concat(F.lit(" ("), "first_fragment", F.lit(")")), F.lit("")))
    listed = rows.where("object_id is not null").select("object_id", line.alias("line")).groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    one = objects.groupBy("id").agg(F.min("name").alias("name"), F.min("kind").alias("kind"))
    head = F.concat(F.lit("# "), F.coalesce("name", F.lit("?")), F.lit("\n\nKind: "), F.coalesce("kind", F.lit("?")), F.lit("\n\n"))
    text = one.join(listed, F.col("id") == F.col("object_id"), "left").select("id", F.concat(head, F.coalesce("body", F.lit("No relationships."))).alias("text"))
    return page_paths(objects).join(text, "id").select("id", "page", "text")


def html(text: Column) -> Column:
    """A page of such Markdown (headings, list items, paragraphs) as HTML."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda c: F.when(c.startswith("# "), F.concat(F.lit("<h1>"), F.regexp_replace(c, "^# ", ""), F.lit("</h1>"))).when(c.startswith("- "), F.concat(F.lit("<li>"), F.regexp_replace(c, "^- ", ""), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), c, F.lit("</p>")))
    return F.array_join(F.transform(F.filter(F.split(safe, "\n"), lambda c: c != ""), line), "\n")


def data_flow(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(origin, from, to, n_steps): the FeedsInto edges between steps of one origin, which is a step's name up to its last colon; n_steps counts the origin's steps. Origins without edges have one row with none."""
    colon = F.length("name") - F.instr(F.reverse("name"), ":")
    steps = objects.where("kind = 'TransformNode'").select("id", F.when(F.col("name").contains(":"), F.substring("name", F.lit(1), colon)).otherwise(F.col("name")).alias("origin"))
    size = steps.groupBy("origin").agg(F.count(F.lit(1)).alias("n_steps"))
    fed = relationships.where(F.lower("kind") == "feedsinto").select("from", "to")
    end = lambda c: steps.select(F.col("id").alias(c), F.col("origin").alias(f"_{c}"))
    edges = fed.join(end("from"), "from").join(end("to"), "to").where("_from = _to").select(F.col("_from").alias("origin"), "from", "to")
    return size.join(edges, "origin", "left").select("origin", "from", "to", "n_steps")


def call_sequences(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(module, from, to): Calls edges by the name of the file that contains the caller, the smallest of several; '(file unknown)' where none does."""
    files = objects.where("kind = 'File'").select(F.col("id").alias("from"), F.col("name").alias("file"))
    holder = relationships.where(F.lower("kind") == "contains").select("from", "to").join(files, "from").groupBy(F.col("to").alias("_to")).agg(F.min("file").alias("file"))
    calls = relationships.where(F.lower("kind") == "calls").select("from", "to")
    return calls.join(holder, F.col("from") == F.col("_to"), "left").select(F.coalesce("file", F.lit("(file unknown)")).alias("module"), "from", "to")


def kind_graph(objects: DataFrame, relationships: DataFrame, kind: str) -> DataFrame:
    """(from_name, kind, to_name): edges between two objects of one kind, data flow left out, each once."""
    named = objects.where(F.col("kind") == kind).groupBy("id").agg(F.min("name").alias("n"))
    end = lambda c: named.select(F.col("id").alias(c), F.col("n").alias(f"{c}_name"))
    r = relationships.where(F.lower("kind") != "feedsinto").select("from", "to", F.lower("kind").alias("kind"))
    return r.join(end("from"), "from").join(end("to"), "to").select("from_name", "kind", "to_name").distinct()
