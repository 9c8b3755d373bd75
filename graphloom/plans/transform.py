"""Transformation IR: plans of Source, Filter, Join, Aggregate, Calculate, Sink and Unmapped nodes, recovered from SQL, PySpark and ETL XML, executed, explained and compared."""

from __future__ import annotations

import ast
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.ids import uuid5

JOIN_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}
AGGREGATES = {"sum", "count", "avg", "min", "max"}


@dataclass
class Node:
    """kind: Source, Filter, Join, Aggregate, Calculate, Sink or Unmapped; what holds for it is in args."""

    kind: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Graph:
    """Nodes with data-flow edges between their places."""

    nodes: list[Node] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)

    def add(self, kind: str, *inputs: int, **args: Any) -> int:
        self.nodes.append(Node(kind, args))
        self.edges += [(i, len(self.nodes) - 1) for i in inputs]
        return len(self.nodes) - 1

    def inputs(self, n: int) -> list[int]:
        return [a for a, b in self.edges if b == n]


class UnmappedError(RuntimeError):
    """A plan to be executed has a node nobody could map."""


# --- execution ---------------------------------------------------------------------------------------------------


def execute(graph: Graph, tables: dict[str, DataFrame], allow_unmapped: bool = False) -> dict[str, DataFrame]:
    """The DataFrame of each sink by name (of the last node, as 'result', where there is none): one lazy plan, Catalyst does the rest."""
    done: dict[int, DataFrame] = {}
    aliases: dict[int, str] = {}
    out = {}
    for n, node in enumerate(graph.nodes):
        ins, a = graph.inputs(n), node.args
        if node.kind == "Source":
            df = tables[a["name"]]
            alias = a.get("alias") or a["name"].split(".")[-1]
            df, aliases[n] = (df.select(*a["columns"]) if a.get("columns") else df).alias(alias), alias
        elif node.kind == "Filter":
            df = done[ins[0]].where(F.expr(a["condition"]))
        elif node.kind == "Join":
            left, right, how = done[ins[0]], done[ins[1]], JOIN_HOW[a.get("how", "inner")]
            if a.get("using"):
                df = left.join(right, a["using"], how)
            elif how == "cross":
                df = left.crossJoin(right)
            elif not (a.get("condition") or a.get("keys")):
                raise UnmappedError(f"{how} join without keys")
            else:
                df = left.join(right, F.expr(a.get("condition") or " AND ".join(f"{l} = {r}" for l, r in a["keys"])), how)
        elif node.kind == "Aggregate":
            aggs = [F.expr(f"{f}({'DISTINCT ' if d else ''}{x})").alias(o) for o, f, x, *rest in a["aggs"] for d in [bool(rest and rest[0])]]
            grouped = done[ins[0]].groupBy(*[F.expr(g).alias(o) for o, g in a["group_by"]])
            df = grouped.agg(*aggs) if aggs else done[ins[0]].select(*[F.expr(g).alias(o) for o, g in a["group_by"]]).distinct()
        elif node.kind == "Calculate":
            df = done[ins[0]].withColumn(a["output"], F.expr(a["expr"]))
        elif node.kind == "Sink":
            df = done[ins[0]].select(*[F.expr(c) for c in a["columns"]]) if a.get("columns") else done[ins[0]]
            out[a["name"]] = df
        elif not allow_unmapped:
            raise UnmappedError(f"{a.get('reason')}: {a.get('raw')}")
        else:
            df = done[ins[0]] if ins else next(iter(tables.values())).limit(0)
        done[n] = df
    return out or {"result": done[len(graph.nodes) - 1]}


# --- SQL, by Spark's own parser ----------------------------------------------------------------------------------


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _sql(expression) -> str:
    """SQL text of an unresolved expression."""
    return expression.sql()


def _name(plan) -> str:
    return plan.getClass().getSimpleName()


def from_sql(spark: SparkSession, sql: str) -> list[Graph]:
    """A graph for each query, view or routine of a script; statements that do not parse and what is not modelled become Unmapped nodes."""
    from graphloom.operators.recovery import statements

    return [_statement(spark, s) for s in statements(sql)]


def from_sql_repaired(spark: SparkSession, sql: str) -> list[Graph]:
    """from_sql; where something of a script does not parse, with separators put between its statements, each of which then stands or falls by itself."""
    from graphloom.operators.recovery import repaired

    broken = lambda gs: sum("does not parse" in (n.args.get("reason") or "") for g in gs for n in g.nodes)
    plain = from_sql(spark, sql)
    if not broken(plain):
        return plain
    again = from_sql(spark, repaired(sql))
    share = lambda gs: broken(gs) / max(1, len(gs))
    return again if share(again) < share(plain) else plain


def _statement(spark: SparkSession, sql: str) -> Graph:
    graph = Graph()
    m = re.match(r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+|temp(?:orary)?\s+)*view\s+([\w.`\"]+)(?:\s*\([^)]*\))?\s+as\s+(.*)$", sql) or re.match(r"(?is)^\s*insert\s+(?:into|overwrite)\s+(?:table\s+)?([\w.`\"]+)\s+(select\b.*)$", sql)
    routine = re.match(r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:procedure|function)\b(.*)$", sql)
    if routine:
        bodies = (re.search(p, routine.group(1)) for p in (r"(?is)\$\$(.*)\$\$", r"(?is)\bbegin\b(.*)\bend\b", r"(?is)\bas\b(.*)$"))
        inner = next((b.group(1) for b in bodies if b), "")
        for part in (p.strip() for p in re.sub(r"(?is)^\s*begin\b|\bend\s*;?\s*$", "", inner).split(";")):
            into = re.match(r"(?is)^insert\s+(?:into|overwrite)\s+(?:table\s+)?([\w.`\"]+)\s+(select\b.*)$", part)
            query = re.match(r"(?is)^(?:return\s+)?(?:query\s+)?\(?\s*(select\b.*?)\)?$", part)
            if into or query:
                _query(spark, into.group(2) if into else query.group(1), into.group(1).strip('`"') if into else None, graph)
            elif part:
                graph.add("Unmapped", raw=part[:200], reason="routine statement")
        if not graph.nodes:
            graph.add("Unmapped", raw=routine.group(1).strip()[:200], reason="routine body")
        return graph
    _query(spark, m.group(2) if m else sql, m.group(1).strip('`"') if m else None, graph)
    return graph


def _query(spark: SparkSession, sql: str, sink: str | None, graph: Graph) -> None:
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # a parser error of the JVM
        graph.add("Unmapped", raw=sql, reason=f"does not parse: {str(e).splitlines()[0][:80]}")
        return
    dropped = []
    while _name(plan) in ("Sort", "GlobalLimit", "LocalLimit", "Distinct", "UnresolvedHaving", "WithWindowDefinition"):
        dropped.append({"Sort": "ORDER BY", "GlobalLimit": "LIMIT", "LocalLimit": "LIMIT", "Distinct": "DISTINCT", "UnresolvedHaving": "HAVING"}.get(_name(plan), _name(plan)))
        plan = plan.child()
    last, columns = _select(plan, graph)
    for what in dict.fromkeys(dropped):
        last = graph.add("Unmapped", *([last] if last is not None else []), raw=what, reason=f"{what} is not modelled")
    if last is not None:
        graph.add("Sink", last, name=sink or "result", columns=columns)


def _relation(plan, graph: Graph) -> int:
    name = _name(plan)
    if name == "SubqueryAlias":
        inner = plan.child()
        if _name(inner) == "UnresolvedRelation":
            return graph.add("Source", name=".".join(_seq(inner.multipartIdentifier())), alias=plan.alias(), columns=[])
        return graph.add("Unmapped", raw=plan.alias(), reason="derived table")
    if name == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        return graph.add("Source", name=".".join(parts), alias=parts[-1], columns=[])
    if name == "Join":
        left, right = _relation(plan.left(), graph), _relation(plan.right(), graph)
        kind = plan.joinType().sql().lower()
        how = "semi" if "semi" in kind else "anti" if "anti" in kind else next((k for k in ("left", "right", "full", "cross", "inner") if k in kind), "inner")
        if "natural" in kind:
            return graph.add("Unmapped", left, right, raw=kind, reason="natural join")
        using = re.match(r"UsingJoin\((\w+),\s*(?:\w+)?[\[(](.*)[\])]\)$", plan.joinType().toString())
        if using:
            cols = [c.strip() for c in using.group(2).split(",")]
            return graph.add("Join", left, right, how=how, using=cols, keys=[(c, c) for c in cols])
        condition = _sql(plan.condition().get()) if plan.condition().isDefined() else None
        keys = []
        for part in re.split(r"\s+AND\s+", condition.strip("()")) if condition else []:
            k = re.fullmatch(r"\(?([\w.`]+) = ([\w.`]+)\)?", part.strip("()"))
            keys = [*keys, (k.group(1), k.group(2))] if k and keys is not None else None
        return graph.add("Join", left, right, how="cross" if condition is None and how == "inner" else how, keys=keys or [], condition=condition)
    return graph.add("Unmapped", raw=name, reason="relation is not modelled")


def _select(plan, graph: Graph) -> tuple[int | None, list[str]]:
    if _name(plan) not in ("Project", "Aggregate"):
        return graph.add("Unmapped", raw=_name(plan), reason="query is not modelled"), []
    child, conditions = plan.child(), []
    while _name(child) == "Filter":
        conditions.append(_sql(child.condition()))
        child = child.child()
    last = _relation(child, graph)
    for c in reversed(conditions):
        last = graph.add("Filter", last, condition=c)
    items = _seq(plan.projectList() if _name(plan) == "Project" else plan.aggregateExpressions())
    named = []
    for e in items:
        cls = _name(e)
        inner, output = (e.child(), e.name()) if cls == "Alias" else (e, None)
        named.append((output or re.sub(r"^.*\.", "", _sql(inner)).strip("`"), inner, cls == "Alias"))
    if any(_name(e) == "UnresolvedStar" for _, e, _ in named):
        return last, []
    if _name(plan) == "Aggregate" or any(_is_aggregate(e) for _, e, _ in named):
        groups = [] if _name(plan) == "Project" else [_sql(g) for g in _seq(plan.groupingExpressions())]
        names = {_sql(e): o for o, e, _ in named}
        group_by = [(names.get(g, re.sub(r"^.*\.", "", g).strip("`")), g) for g in groups]
        aggs, later = [], []
        for o, e, _ in named:
            if _is_aggregate(e):
                arg = ", ".join(_sql(x) for x in _seq(e.arguments())) or "*"
                aggs.append((o, ".".join(_seq(e.nameParts())).lower(), arg, e.isDistinct()))
            elif _sql(e) not in groups:
                later.append((o, e))
        last = graph.add("Aggregate", last, group_by=group_by, aggs=aggs)
        for o, e in later:
            last = graph.add("Unmapped", last, raw=f"{_sql(e)} AS {o}", reason="expression over aggregates")
        return last, [o for o, e, _ in named if _is_aggregate(e) or _sql(e) in groups]
    columns = []
    for o, e, aliased in named:
        if aliased or not re.fullmatch(r"[\w.`]+", _sql(e)):
            last = graph.add("Calculate", last, output=o, expr=_sql(e))
            columns.append(o)
        else:
            columns.append(_sql(e))
    return last, columns


def _is_aggregate(e) -> bool:
    return _name(e) == "UnresolvedFunction" and _seq(e.nameParts())[-1].lower() in AGGREGATES


# --- PySpark chains ----------------------------------------------------------------------------------------------


def from_python(source: str) -> list[Graph]:
    """A graph for each statement of a Python source that chains DataFrame calls from a table; spark.sql(...) is Unmapped, other calls are passed over."""
    out = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    for stmt in ast.walk(tree):
        value = getattr(stmt, "value", None) if isinstance(stmt, (ast.Assign, ast.Expr, ast.Return)) else None
        if isinstance(value, ast.Call):
            graph = Graph()
            _chain(value, graph)
            if graph.nodes:
                out.append(graph)
    return out


def _text(node: ast.AST) -> str:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ast.unparse(node)


def _chain(call: ast.Call, graph: Graph) -> int | None:
    if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Attribute):
        return None
    name, args = call.func.attr, call.args
    keywords = {k.arg: k.value for k in call.keywords}
    if name in ("table", "load", "parquet") and args:
        return graph.add("Source", name=_text(args[0]), columns=[])
    if name == "sql" and isinstance(call.func.value, ast.Name) and call.func.value.id == "spark":
        return graph.add("Unmapped", raw=_text(args[0]) if args else "", reason="spark.sql text")
    grouped = call.func.value
    if name == "agg" and isinstance(grouped, ast.Call) and isinstance(grouped.func, ast.Attribute) and grouped.func.attr in ("groupBy", "groupby"):
        before = _chain(grouped.func.value, graph)
        aggs = []
        for a in args:
            if isinstance(a, ast.Call) and isinstance(a.func, ast.Attribute) and a.func.attr == "alias" and isinstance(a.func.value, ast.Call) and isinstance(a.func.value.func, ast.Attribute):
                f = a.func.value
                aggs.append((_text(a.args[0]), f.func.attr, _text(f.args[0]) if f.args else "*"))
        return None if before is None else graph.add("Aggregate", before, group_by=[(_text(g), _text(g)) for g in grouped.args], aggs=aggs)
    before = _chain(grouped, graph)
    if before is None and isinstance(grouped, ast.Attribute):
        before = _chain(grouped.value, graph)
    if before is None:
        return None
    if name in ("filter", "where") and args:
        return graph.add("Filter", before, condition=_text(args[0]))
    if name == "withColumn" and len(args) == 2:
        return graph.add("Calculate", before, output=_text(args[0]), expr=_text(args[1]))
    if name == "join" and args:
        other = _chain(args[0], graph)
        if other is None:
            other = graph.add("Source", name=_text(args[0]), columns=[])
        on = args[1] if len(args) > 1 else keywords.get("on")
        how = _text(args[2]) if len(args) > 2 else _text(keywords["how"]) if "how" in keywords else "inner"
        keys = [(_text(k), _text(k)) for k in (on.elts if isinstance(on, (ast.List, ast.Tuple)) else [on])] if on is not None else []
        kind = "semi" if "semi" in how else "anti" if "anti" in how else next((k for k in ("left", "right", "cross") if how.startswith(k)), "full" if how.startswith(("full", "outer")) else "inner")
        return graph.add("Join", before, other, how=kind, keys=keys, using=[k for k, _ in keys])
    if name in ("saveAsTable", "save", "insertInto") and args:
        return graph.add("Sink", before, name=_text(args[0]), columns=[])
    return before


# --- ETL XML -----------------------------------------------------------------------------------------------------


def from_kettle(xml: str) -> Graph:
    """The steps and hops of a transformation; a job's entries are all Unmapped, as is what does not parse."""
    graph = Graph()
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        graph.add("Unmapped", raw=xml[:200], reason=f"does not parse: {e}")
        return graph
    if root.tag == "job":
        for e in root.iter("entry"):
            graph.add("Unmapped", raw=e.findtext("name", ""), reason=f"job entry {e.findtext('type', '')}")
        return graph
    places: dict[str, int] = {}
    for step in root.iter("step"):
        kind, text = step.findtext("type", ""), lambda p, s=step: (s.findtext(p) or "").strip()
        if kind == "TableInput":
            n = graph.add("Source", name=text("table") or (re.search(r"(?i)\bfrom\s+([\w.]+)", text("sql")) or [None, text("sql")])[1], columns=[])
        elif kind == "FilterRows":
            c = step.find(".//condition")
            right = c.findtext("rightvalue") or c.findtext("value/text") or "" if c is not None else ""
            n = graph.add("Filter", condition=f"{c.findtext('leftvalue', '')} {c.findtext('function', '=')} {right}".strip() if c is not None else "")
        elif kind == "Calculator":
            sign = {"ADD": "+", "SUBTRACT": "-", "MULTIPLY": "*", "DIVIDE": "/"}
            c = step.find(".//calculation")
            g = (lambda p: (c.findtext(p) or "").strip()) if c is not None else lambda p: ""
            n = graph.add("Calculate", output=g("field_name"), expr=f"{g('field_a')} {sign.get(g('calc_type'), g('calc_type'))} {g('field_b')}".strip())
        elif kind in ("DatabaseJoin", "MergeJoin", "StreamLookup"):
            pairs = [(k.findtext("name", "").strip(), k.findtext("field", "").strip()) for k in step.iter("key") if k.findtext("name")]
            if not pairs:
                a, b = ([(f.text or "").strip() for f in step.findall(f"{t}/key")] for t in ("keys_1", "keys_2"))
                pairs = list(zip(a, b))
            if not pairs:
                pairs = [((p.findtext("name") or "").strip(), (p.findtext("name") or "").strip()) for p in step.iter("field") if p.findtext("name")]
            how = "left" if kind == "StreamLookup" else next((k for k in ("left", "right", "full") if k in text("join_type").lower()), "inner")
            n = graph.add("Join", keys=pairs, how=how)
        elif kind == "GroupBy":
            group = [(f.findtext("name", "").strip(),) * 2 for f in step.findall("group/field")]
            aggs = [(f.findtext("aggregate", "").strip(), f.findtext("type", "").strip().lower(), f.findtext("subject", "").strip()) for f in step.findall("fields/field")]
            n = graph.add("Aggregate", group_by=group, aggs=aggs)
        elif kind == "TableOutput":
            n = graph.add("Sink", name=text("table"), columns=[])
        else:
            n = graph.add("Unmapped", raw=text("name"), reason=f"step {kind}")
        places[text("name")] = n
    for hop in root.iter("hop"):
        a, b = places.get(hop.findtext("from", "")), places.get(hop.findtext("to", ""))
        if a is not None and b is not None:
            graph.edges.append((a, b))
    return graph


# --- coverage, comparison, sentences, dbt ------------------------------------------------------------------------


def coverage(graph: Graph) -> float:
    """The share of mapped nodes in per cent; 0 for an empty graph."""
    return 100.0 * sum(n.kind != "Unmapped" for n in graph.nodes) / len(graph.nodes) if graph.nodes else 0.0


def comparable(node: Node) -> str:
    """What makes a node equal to another; the sides and order of join keys do not."""
    a = node.args
    if node.kind in ("Source", "Sink"):
        return a["name"]
    if node.kind == "Filter":
        return a["condition"]
    if node.kind == "Join":
        return f"{a.get('how', 'inner')} " + ",".join(sorted("=".join(sorted(k)) for k in a.get("keys") or []))
    if node.kind == "Aggregate":
        return ",".join(sorted(g for _, g in a["group_by"])) + " | " + ",".join(sorted(f"{x[1]}({x[2]})" for x in a["aggs"]))
    return f"{a['output']} = {a['expr']}" if node.kind == "Calculate" else f"{a.get('reason')}"


def structural_diff(old: Graph, new: Graph) -> dict[str, dict[str, list[str]]]:
    """Per node kind what the new graph adds and lacks, sorted; kinds without a difference are left out."""
    out = {}
    for kind in ("Source", "Filter", "Join", "Aggregate", "Calculate", "Sink", "Unmapped"):
        a, b = ({comparable(n) for n in g.nodes if n.kind == kind} for g in (old, new))
        if a != b:
            out[kind] = {"added": sorted(b - a), "removed": sorted(a - b)}
    return out


def explain(graph: Graph) -> list[str]:
    """One sentence a node."""
    says = {"Source": "reads {}", "Filter": "keeps rows where {}", "Join": "joins its inputs: {}", "Aggregate": "groups and aggregates: {}", "Calculate": "computes {}", "Sink": "writes {}", "Unmapped": "is not understood: {}"}
    return [f"Step {i} {says[n.kind].format(comparable(n))}." for i, n in enumerate(graph.nodes)]


def explain_nodes(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, sentence, first_fragment): a sentence for each node object (id, name, node_type, evidence) with the first of its evidence that exists."""
    says = {"Source": "reads data", "Filter": "keeps some rows", "Join": "joins its inputs", "Aggregate": "groups and aggregates", "Calculate": "computes a column", "Sink": "writes data"}
    what = F.lit("is not understood")
    for kind, sentence in says.items():
        what = F.when(F.col("node_type") == kind, sentence).otherwise(what)
    text = evidence.groupBy("id").agg(F.min("fragment").alias("fragment")).select(F.col("id").alias("_e"), "fragment")
    first = nodes.select("id", F.posexplode("evidence").alias("_p", "_e")).join(text, "_e").groupBy("id").agg(F.min_by("fragment", "_p").alias("first_fragment"))
    return nodes.join(first, "id", "left").select("id", F.concat(F.coalesce("name", F.lit("?")), F.lit(" "), what, F.lit(".")).alias("sentence"), "first_fragment")


def lower(spark: SparkSession, graphs: list[tuple[str, str, Graph]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, FeedsInto edges) of graphs (path, kind, graph) as objects with name-based ids."""
    nodes = [(p, k, i, n.kind, comparable(n)) for p, k, g in graphs for i, n in enumerate(g.nodes)]
    edges = [(p, k, a, b) for p, k, g in graphs for a, b in g.edges]
    key = lambda c: uuid5(F.concat(F.lit("transform:"), "kind", F.lit(":"), "path", F.lit(":node:"), F.col(c).cast("string")))
    n = spark.createDataFrame(nodes, "path string, kind string, idx int, node_type string, shown string")
    e = spark.createDataFrame(edges, "path string, kind string, a int, b int")
    return n.select(key("idx").alias("id"), F.concat("path", F.lit(":"), F.col("idx").cast("string")).alias("name"), "node_type", "shown"), e.select(key("a").alias("from"), key("b").alias("to"), F.lit("FeedsInto").alias("kind"))


def python_nodes(files: DataFrame) -> DataFrame:
    """(file_id, graph, idx, node_type, shown): the IR of all Python files (file_id, path, source)."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["file_id"], pdf["source"]):
                for g, graph in enumerate(from_python(s) if isinstance(s, str) else []):
                    out += [(i, g, k, n.kind, comparable(n)) for k, n in enumerate(graph.nodes)]
            yield pd.DataFrame(out, columns=["file_id", "graph", "idx", "node_type", "shown"])

    return files.where(F.lower("path").endswith(".py")).select("file_id", "source").mapInPandas(run, "file_id bigint, graph int, idx int, node_type string, shown string")


def slug(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.lower())).strip("_") or "model"


def to_dbt(graph: Graph, source_group: str = "raw") -> dict[str, str]:
    """File name to text of a dbt project: a model a node but sources, and schema.yml. A join with one input joins it to itself."""
    names = {i: f"{slug(comparable(n) if n.kind in ('Sink',) else n.kind)}_{i}" for i, n in enumerate(graph.nodes)}
    ref = lambda i: f"{{{{ source('{source_group}', '{graph.nodes[i].args['name']}') }}}}" if graph.nodes[i].kind == "Source" else f"{{{{ ref('{names[i]}') }}}}"
    files = {}
    for i, n in enumerate(graph.nodes):
        ups, a = graph.inputs(i), n.args
        if n.kind == "Source":
            continue
        base = ref(ups[0]) if ups else "-- no input"
        if n.kind == "Filter":
            sql = f"select * from {base} where {a['condition']}"
        elif n.kind == "Join":
            other = ref(ups[1]) if len(ups) > 1 else base
            on = " and ".join(f"l.{x.split('.')[-1]} = r.{y.split('.')[-1]}" for x, y in a.get("keys") or []) or "true"
            sql = f"select * from {base} l {a.get('how', 'inner')} join {other} r on {on}"
        elif n.kind == "Aggregate":
            groups = [g for _, g in a["group_by"]]
            items = [*groups, *[f"{x[1]}({x[2]}) as {x[0]}" for x in a["aggs"]]]
            sql = f"select {', '.join(items)} from {base}" + (f" group by {', '.join(groups)}" if groups else "")
        elif n.kind == "Calculate":
            sql = f"select *, {a['expr']} as {a['output']} from {base}"
        elif n.kind == "Sink":
            sql = f"select {', '.join(a.get('columns') or ['*'])} from {base}"
        else:
            sql = f"-- not mapped ({a.get('reason')}): {str(a.get('raw'))[:120]}\nselect * from {base}"
        files[f"models/{names[i]}.sql"] = sql + "\n"
    tables = sorted({n.args["name"] for n in graph.nodes if n.kind == "Source"})
    models = sorted(names[i] for i, n in enumerate(graph.nodes) if n.kind != "Source")
    files["models/schema.yml"] = "\n".join(["version: 2", "sources:", f"  - name: {source_group}", "    tables:", *[f"      - name: {t}" for t in tables], "models:", *[f"  - name: {m}" for m in models]]) + "\n"
    return files
