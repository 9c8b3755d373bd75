"""Facts recovered from sources: co-change, authorship, issue and page links, technologies, DDL, crates, pipelines, Python modules, text tables."""

from __future__ import annotations

import ast
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions import text
from graphloom.functions.ids import uuid5


def co_changes(commits: DataFrame, most_files: int = 50, least: int = 2) -> DataFrame:
    """(file_a, file_b, co_change_count): files changed together in at least so many commits of at most most_files files; a commit observed twice counts once.

    The size guard is part of the meaning and bounds the pairs of a commit, so the pairs of each row come from its own array without a join.
    """
    once = commits.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("files_changed").alias("f"))
    files = once.where((F.size("f") <= most_files) & (F.size("f") >= 2)).select(F.array_sort(F.array_compact("f")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice(F.col("f"), i + 2, F.size("f")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))
    return files.select(F.explode(pairs).alias("p")).where("p.file_a < p.file_b").groupBy("p.file_a", "p.file_b").agg(F.count(F.lit(1)).alias("co_change_count")).where(F.col("co_change_count") >= least)


def people(commits: DataFrame) -> DataFrame:
    """(person_id, author_name, commit_count) by distinct commits."""
    one = commits.where("sha is not null and author_name is not null").select("sha", "author_name").distinct()
    return one.groupBy("author_name").agg(F.count(F.lit(1)).alias("commit_count")).select(uuid5(F.concat(F.lit("contributor:"), "author_name")).alias("person_id"), "author_name", "commit_count")


def ownership(commits: DataFrame, listed: DataFrame) -> DataFrame:
    """(event_id, person_id) of commits whose author is listed (author_name)."""
    one = commits.where("sha is not null").select("sha", "author_name").distinct().join(listed.select("author_name").distinct(), "author_name")
    return one.select(uuid5(F.concat(F.lit("event:"), "sha")).alias("event_id"), uuid5(F.concat(F.lit("contributor:"), "author_name")).alias("person_id"))


def issue_links(items: DataFrame) -> DataFrame:
    """(from_number, to_number, kind) of items (repo, number, body): closes, and mentions of others that are not closed; also by full address of the same repository."""
    closed = items.select("repo", "number", F.explode(text.closed_issues(F.col("body"))).alias("to_number"), F.lit("closes").alias("kind"))
    url = F.transform(F.regexp_extract_all("body", F.concat(F.lit("(?i)github\\.com/"), F.regexp_replace("repo", r"([^\w/-])", r"\\$1"), F.lit(r"/(?:issues|pull)/(\d{1,9})")), F.lit(1)), lambda x: x.cast("bigint"))
    others = F.array_sort(F.array_except(F.array_union(text.mentioned_issues(F.col("body")), url), text.closed_issues(F.col("body"))))
    mentioned = items.select("repo", "number", F.explode(others).alias("to_number"), F.lit("mentions").alias("kind")).where("to_number <> number")
    return closed.unionByName(mentioned).select("repo", F.col("number").alias("from_number"), "to_number", "kind")


def file_references(items: DataFrame) -> DataFrame:
    """(from_id, path, kind): References from each item (id, files_changed) to each file it changes, once each."""
    return items.select(F.col("id").alias("from_id"), F.explode("files_changed").alias("path"), F.lit("References").alias("kind")).where("path is not null").distinct()


SECTION_EXCERPT = 1200


def document_parts(documents: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, part, excerpt): Contains from each document (doc_id, text) to its sections, with their first 1,200 characters, and to its text tables."""
    of = lambda part, n: F.concat(F.col("doc_id").cast("string"), F.lit(f"#{part}-"), n.cast("string"))
    row = lambda part, n, shown: [F.col("doc_id").cast("string").alias("from_id"), of(part, n).alias("to_id"), F.lit("Contains").alias("kind"), F.lit(part).alias("part"), shown.alias("excerpt")]
    sections = documents.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("position", "section")).select(*row("section", F.col("position") + 1, text.excerpt(F.col("section"), SECTION_EXCERPT)))
    return sections.unionByName(text_tables(documents).select(*row("table", F.col("first_line"), F.lit(None).cast("string"))))


def page_links(pages: DataFrame) -> DataFrame:
    """(from_id, to_id, kind) of pages (id, parent_id, title, body): Contains from parents, seen or not, and References by exact title within the batch."""
    contains = pages.where("parent_id is not null").select(F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("Contains").alias("kind"))
    named = pages.select("id", F.explode(text.linked_titles(F.col("body"))).alias("title"))
    targets = pages.groupBy("title").agg(F.min("id").alias("to_id"))
    return contains.unionByName(named.join(targets, "title").select(F.col("id").alias("from_id"), "to_id", F.lit("References").alias("kind"))).distinct()


def technology_use(files: DataFrame) -> DataFrame:
    """(file_id, technology): each file's obvious technologies."""
    return files.select("file_id", F.explode(text.technologies(F.col("source"))).alias("technology")).distinct()


def graph_export(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, edges, diagnostics) of an exported batch: of an id's rows the smallest counts, edges with an end outside the batch go to diagnostics, those without evidence stay and are noted."""
    objects = entities.groupBy("entity_id").agg(F.min(F.struct("kind", "name", "attrs")).alias("v")).select("entity_id", "v.*")
    ids = objects.select("entity_id")
    inside = relationships.join(ids.withColumnRenamed("entity_id", "src_entity_id"), "src_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "dst_entity_id"), "dst_entity_id", "left_semi")
    outside = relationships.join(ids.withColumnRenamed("entity_id", "src_entity_id"), "src_entity_id", "left_anti").unionByName(
        relationships.join(ids.withColumnRenamed("entity_id", "src_entity_id"), "src_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "dst_entity_id"), "dst_entity_id", "left_anti")
    )
    note = lambda df, why: df.select("src_entity_id", "dst_entity_id", F.lit(why).alias("diagnostic"))
    return objects, inside, note(outside, "end outside batch").unionByName(note(inside.where(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0), "no evidence"))


def text_tables(documents: DataFrame) -> DataFrame:
    """(doc_id, first_line, n_rows, n_columns): runs of two lines or more that split at two blanks or more into the same number of fields, two at least."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    fields = F.filter(F.split(F.trim("t"), "[ \t]{2,}"), lambda x: x != "")
    rows = lines.select("doc_id", "line", F.size(fields).alias("n")).where("n >= 2")
    w = Window.partitionBy("doc_id").orderBy("line")
    runs = rows.withColumn("island", F.col("line") - F.row_number().over(w))
    return runs.groupBy("doc_id", "island").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("n_columns"), F.max("n").alias("_m")).where("n_rows >= 2 and n_columns = _m").select("doc_id", "first_line", "n_rows", "n_columns")


# --- small texts, parsed whole in Python -----------------------------------------------------------------------------

_QUOTED = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$]+)'
_NAME = rf"{_QUOTED}(?:\s*\.\s*{_QUOTED})*"
_CREATE = re.compile(rf"^\s*create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*\(", re.I | re.S)
_FOREIGN = re.compile(rf"foreign\s+key\s*\(([^)]*)\)\s*references\s+({_NAME})\s*(?:\(([^)]*)\))?", re.I)
_INLINE = re.compile(rf"references\s+({_NAME})\s*(?:\(([^)]*)\))?", re.I)
_CONSTRAINT = re.compile(r"^(?:constraint|primary|foreign|unique|check|exclude|key|index|partition|period|like)\b", re.I)


def plain_name(name: str) -> str:
    return ".".join(p.strip().strip('"`[]') for p in re.findall(_QUOTED, name))


_ROUTINE = re.compile(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:procedure|function|trigger)\b")
_LITERAL = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`")


def _inside_routine(text: str) -> bool:
    """Whether a text that begins a routine has a BEGIN, or a CASE or IF within it, whose END is still to come."""
    if not _ROUTINE.match(text):
        return False
    words = re.findall(r"(?i)\b(begin|case|if|loop|end(?:\s+(?:if|case|loop))?)\b", _LITERAL.sub(" ", text))
    depth = 0
    for w in (x.lower() for x in words):
        if w == "begin" or (depth and w in ("case", "if", "loop")):
            depth += 1
        elif w.startswith("end") and depth:
            depth -= 1
    return depth > 0


def statements(sql: str) -> list[str]:
    """The statements of a script: comments go, ; within quotes, $$ bodies and the BEGIN and END of routines does not split, a missing one before a new CREATE or INSERT is put in."""
    sql = re.sub(r"--[^\n]*|/\*.*?\*/|(?m:^\s*#[^\n]*)", " ", sql, flags=re.S)
    out, cur, quote = [], "", ""
    for c in sql:
        if quote == "$$":
            quote = "" if c == "$" and cur.endswith("$") else quote
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "$" and cur.endswith("$"):
            quote = "$$"
        if c == ";" and not quote and not _inside_routine(cur):
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [s.strip() for part in [*out, cur] for s in re.split(r"(?im)(?<=\))\s*\n(?=\s*(?:create|insert|alter|drop)\s)", part) if s.strip()]


_STARTS = re.compile(r"(?i)^\s*(?:select|insert|update|delete|create|alter|drop|with|merge|truncate)\b")
_SET_OPERATION = re.compile(r"(?i)\b(?:union(?:\s+all)?|intersect|except)\s*$")


def repaired(sql: str) -> str:
    """A script with a ; put before each line that begins a statement, outside brackets, where the one before has none and does not end in a set operation.

    Only for scripts that do not parse as they are: a statement of several lines may well have a line that begins so.
    """
    out, depth, open_, joined = [], 0, False, False
    for line in sql.splitlines():
        if depth == 0 and open_ and not joined and _STARTS.match(line):
            out.append(";")
        out.append(line)
        depth = max(0, depth + line.count("(") - line.count(")"))
        if line.strip():
            joined = bool(_SET_OPERATION.search(line))
            open_ = not (depth == 0 and line.rstrip().endswith(";"))
    return "\n".join(out)


def _items(body: str) -> list[str]:
    out, depth, cur, quote = [], 0, "", ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        depth += (c == "(") - (c == ")") if not quote else 0
        if c == "," and not depth and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [i.strip() for i in [*out, cur] if i.strip()]


def ddl(sql: str) -> tuple[list[tuple[str, list[tuple[str, str]]]], list[tuple[str, str, str, str]]]:
    """(tables with their columns, foreign keys (table, column, target, target column)) of CREATE TABLE statements; keys to unknown tables are dropped."""
    tables, keys = [], []
    for s in statements(sql):
        m = _CREATE.match(s)
        if not m:
            continue
        name, depth, end = plain_name(m.group(1)), 1, m.end()
        while end < len(s) and depth:
            depth += (s[end] == "(") - (s[end] == ")")
            end += 1
        columns = []
        for item in _items(s[m.end() : end - 1]):
            if _CONSTRAINT.match(item) and not re.match(r"^(?:key|index|like|period)\s+\w+(?:\(|\s*$|,)", item[:0]):
                if f := _FOREIGN.search(item):
                    targets = [plain_name(c) for c in (f.group(3) or "id").split(",")]
                    keys += [(name, plain_name(c), plain_name(f.group(2)), targets[min(i, len(targets) - 1)]) for i, c in enumerate(f.group(1).split(","))]
                continue
            c = re.match(rf"({_QUOTED})\s*(\w+(?:\s+(?:varying|precision|with(?:out)?\s+time\s+zone|unsigned))*(?:\s*\([^)]*\))?)?", item, re.I)
            if not c:
                continue
            columns.append((plain_name(c.group(1)), (c.group(2) or "").strip()))
            if r := _INLINE.search(item):
                keys.append((name, columns[-1][0], plain_name(r.group(1)), plain_name(r.group(2)) if r.group(2) else "id"))
        tables.append((name, columns))
    known = {t.lower() for t, _ in tables} | {t.lower().split(".")[-1] for t, _ in tables}
    return tables, [k for k in keys if k[2].lower() in known or k[2].lower().split(".")[-1] in known]


def table_definitions(scripts: DataFrame) -> DataFrame:
    """(path, table_name, column_name, data_type, position, references_table, references_column) of scripts (path, text)."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, sql in zip(pdf["path"], pdf["text"]):
                tables, keys = ddl(sql) if isinstance(sql, str) else ([], [])
                at = {(t, c): (r, rc) for t, c, r, rc in keys}
                out += [(path, t, c, k, i, *at.get((t, c), (None, None))) for t, columns in tables for i, (c, k) in enumerate(columns)]
            yield pd.DataFrame(out, columns=["path", "table_name", "column_name", "data_type", "position", "references_table", "references_column"])

    return scripts.select("path", "text").mapInPandas(run, "path string, table_name string, column_name string, data_type string, position int, references_table string, references_column string")


#: What dialects add to CREATE TABLE that the definitions above have no use for; fixed values.
DIALECT_NOISE = {
    "postgres": [r"\bNOT\s+VALID\b", r"\bUNLOGGED\b"],
    "mysql": [r"(?im)^\s*DELIMITER\s+\S+\s*$"],
    "clickhouse": [r"\bCODEC\s*\([^()]*(?:\([^()]*\)[^()]*)*\)", r"(?is),\s*INDEX\s+\w+\s.*?GRANULARITY\s+\d+", r"(?is)\bPARTITION\s+BY\s+[^\n]+", r"(?is)\bSAMPLE\s+BY\s+[^\n]+", r"(?is)\bSETTINGS\s+[^;]+", r"(?is)\bCREATE\s+DICTIONARY\b[^;]*;?"],
    "mssql": [], "snowflake": [], "databricks": [], "generic": [],
}


def resolve_dialect(rules: list[tuple[str, str]], default: str, path: str) -> str:
    """The dialect of the first rule (glob, name) whose glob matches the path; unknown names are generic."""
    for glob, name in rules:
        if re.match(text.glob_regex(glob), path):
            return name if name in DIALECT_NOISE else "generic"
    return default if default in DIALECT_NOISE else "generic"


def preprocess(sql: str, dialect: str) -> str:
    """A script without what its dialect adds, text in quotes left alone."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    for pattern in DIALECT_NOISE.get(dialect, []):
        parts = [p if i % 2 else re.sub(pattern, "", p, flags=re.I) for i, p in enumerate(parts)]
    return "".join(parts)


def python_module(source: str) -> dict | None:
    """Top-level functions, classes and imports of a module; None if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    names = [(n.name, "class" if isinstance(n, ast.ClassDef) else "function") for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names] + [("." * n.level) + (n.module or "") for n in tree.body if isinstance(n, ast.ImportFrom)]
    return {"symbols": names, "imports": sorted(set(imports))}


def python_symbols(files: DataFrame) -> DataFrame:
    """(file_id, name, kind) of the top-level symbols and imports of Python files (file_id, path, source) that parse."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["file_id"], pdf["source"]):
                if isinstance(s, str) and (m := python_module(s)):
                    out += [(i, n, k) for n, k in m["symbols"]] + [(i, n, "import") for n in m["imports"]]
            yield pd.DataFrame(out, columns=["file_id", "name", "kind"])

    return files.where(F.lower("path").endswith(".py")).select("file_id", "source").mapInPandas(run, "file_id bigint, name string, kind string")


_RUST_ITEM = re.compile(r"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod|const|static|type|union)\s+(\w+)")


def rust_symbols(files: DataFrame) -> DataFrame:
    """(file_id, name, kind): items declared at the start of a line of Rust files, and calls name(...) that one function of the file and no other declares."""
    code = files.where(F.lower("path").endswith(".rs") & F.col("source").isNotNull()).select("file_id", "source")

    def run(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["file_id"], pdf["source"]):
                bare = re.sub(r'//[^\n]*|r(#*)".*?"\1|"(?:\\.|[^"\\])*"', " ", s, flags=re.S)
                items = _RUST_ITEM.findall(bare)
                out += [(i, n, k) for k, n in items]
                once = [n for n in {n for k, n in items if k == "fn"} if sum(m == n and k == "fn" for k, m in items) == 1]
                called = set(re.findall(r"(?<![\w.:!])(\w+)\s*\(", re.sub(r"\bfn\s+\w+\s*(?:<[^>]*>)?\s*\(", " ", bare)))
                out += [(i, n, "call") for n in sorted(set(once) & called)]
            yield pd.DataFrame(out, columns=["file_id", "name", "kind"])

    return code.mapInPandas(run, "file_id bigint, name string, kind string")


_RUST_USE = re.compile(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);")
_RUST_IMPL = re.compile(r"(?m)^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>,' &]+?\s+for\s+)?([\w:]+)[^{;]*\{")
_RUST_FN = re.compile(r"\bfn\s+(\w+)\s*(?:<[^{;(]*>)?\s*\(")


def rust_bare(source: str) -> str:
    """Rust source with comments and the contents of text and character literals blanked, places kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group(0))
    return re.sub(r"""//[^\n]*|/\*.*?\*/|\br(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\\n])'""", blank, source, flags=re.S)


def rust_imports(tree: str) -> list[str]:
    """The paths of a use tree: a::{b, c as d, e::*} gives a::b, a::c, a::e::*; self stands for its parent."""
    tree = re.sub(r"\s+as\s+\w+", "", re.sub(r"\s+", " ", tree)).strip()
    at = tree.find("{")
    if at < 0:
        return [tree.removesuffix("::self")]
    head, inner, depth, part, out = tree[:at].strip(), tree[at + 1 : tree.rfind("}")], 0, "", []
    for c in inner + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            out += [(head + p).removesuffix("::self") for p in (rust_imports(part) if part.strip() else [])]
            part = ""
        else:
            part += c
    return out


def _block_end(bare: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(bare, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(bare)


def rust_module(source: str) -> dict[str, list]:
    """functions (name, owner), where owner is the type of the impl or trait around, imports, and calls (caller, callee) to functions that the file declares once."""
    bare = rust_bare(source)
    owners = [(m.start(), _block_end(bare, m.end() - 1), m.group(1).split("::")[-1]) for m in _RUST_IMPL.finditer(bare)]
    owners += [(m.start(), _block_end(bare, m.end() - 1), m.group(1)) for m in re.finditer(r"\btrait\s+(\w+)[^{;]*\{", bare)]
    functions = []
    for m in _RUST_FN.finditer(bare):
        body = re.compile(r"[{;]").search(bare, m.end())
        end = _block_end(bare, body.start()) if body and body.group() == "{" else m.end()
        owner = next((o for a, b, o in owners if a <= m.start() < b), None)
        functions.append((m.group(1), owner, body.start() if body else m.end(), end))
    declared = [n for n, *_ in functions]
    once = {n for n in declared if declared.count(n) == 1}
    calls = {(n, c) for n, _, a, b in functions for c in re.findall(r"(?<![\w!])(\w+)\s*\(", re.sub(r"\bfn\s+\w+", " ", bare[a:b])) if c in once}
    return {"functions": [(n, o) for n, o, *_ in functions], "imports": sorted({p for m in _RUST_USE.finditer(bare) for p in rust_imports(m.group(1))}), "calls": sorted(calls)}


def rust_graph(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, target) of Rust files: function and method (target its type), import (the path) and call (caller, callee; only to what the file declares once)."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["file_id"], pdf["source"]):
                m = rust_module(s)
                out += [(i, "method" if o else "function", n, o) for n, o in m["functions"]] + [(i, "import", p, None) for p in m["imports"]] + [(i, "call", a, b) for a, b in m["calls"]]
            yield pd.DataFrame(out, columns=["file_id", "kind", "name", "target"])

    code = files.where(F.lower("path").endswith(".rs") & F.col("source").isNotNull()).select("file_id", "source")
    return code.mapInPandas(run, "file_id bigint, kind string, name string, target string")


def crate(manifest: str) -> dict | None:
    """Name and dependencies (name, how, detail) of a Cargo manifest: path, version or workspace; None if it does not parse or names no package."""
    try:
        data = tomllib.loads(manifest)
    except (tomllib.TOMLDecodeError, TypeError):
        return None
    if "name" not in data.get("package", {}):
        return None
    out = []
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, spec in data.get(section, {}).items():
            spec = {"version": spec} if isinstance(spec, str) else spec
            how = next((h for h in ("path", "workspace", "version", "git") if h in spec), "version")
            out.append((name, how, str(spec.get(how, ""))))
    return {"name": data["package"]["name"], "dependencies": out}


def crate_gaps(topology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gaps (crate, dependency), claims (crate, dependency, statement, status)) of crate_topology: a gap for each path or workspace dependency that no crate is, a claim for each dependency."""
    gaps = topology.where("not resolved and how in ('path', 'workspace')").select("crate", "dependency").distinct()
    claims = topology.select("crate", "dependency", F.concat("crate", F.lit(" depends on "), "dependency").alias("statement"), F.when(F.col("resolved"), "supported").when(F.col("how").isin("path", "workspace"), "unresolved").otherwise("external").alias("status")).distinct()
    return gaps, claims


def crate_topology(files: DataFrame) -> DataFrame:
    """(crate, dependency, how, resolved) of TOML files (file_id, path, source): resolved if a crate of that name was seen."""

    def run(batches):
        for pdf in batches:
            out = []
            for s in pdf["source"]:
                if isinstance(s, str) and (c := crate(s)):
                    out += [(c["name"], None, None)] + [(c["name"], d, h) for d, h, _ in c["dependencies"]]
            yield pd.DataFrame(out, columns=["crate", "dependency", "how"])

    rows = files.where(F.lower("path").endswith(".toml")).select("source").mapInPandas(run, "crate string, dependency string, how string")
    seen = rows.select(F.col("crate").alias("dependency"), F.lit(True).alias("there")).distinct()
    deps = rows.where("dependency is not null").distinct()
    return deps.join(seen, "dependency", "left").select("crate", "dependency", "how", F.coalesce("there", F.lit(False)).alias("resolved"))


def pipeline(path: str, document: str) -> dict | None:
    """Name, triggers and jobs with steps of a CI definition; triggers may be a text, a list or a mapping, and the key on may read as true."""
    import yaml

    try:
        data = yaml.safe_load(document)
    except yaml.YAMLError:
        return None
    if not isinstance(data, dict):
        return None
    on = data.get("on", data.get(True, []))
    triggers = [on] if isinstance(on, str) else list(on) if isinstance(on, (list, dict)) else []
    jobs = data.get("jobs") if isinstance(data.get("jobs"), dict) else {}
    steps = {j: [s.get("name") or s.get("uses") or s.get("run") for s in (spec or {}).get("steps", []) if isinstance(s, dict)] for j, spec in jobs.items()}
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return {"name": data.get("name") or stem, "triggers": [str(t) for t in triggers], "jobs": steps}


def pipelines(files: DataFrame) -> DataFrame:
    """(path, name, triggers, job, steps) of CI definitions (path, text), one row a job; a definition without jobs has one row without a job, what does not parse none."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, body in zip(pdf["path"], pdf["text"]):
                if isinstance(path, str) and isinstance(body, str) and (p := pipeline(path, body)):
                    out += [(path, p["name"], p["triggers"], j, [str(s) for s in steps]) for j, steps in (p["jobs"].items() or [(None, [])])]
            yield pd.DataFrame(out, columns=["path", "name", "triggers", "job", "steps"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, triggers array<string>, job string, steps array<string>")


def concepts(documents: DataFrame, extract) -> tuple[DataFrame, DataFrame]:
    """(mentions (doc_id, concept_id, concept), relations (doc_id, from, to, kind)) that a model finds in documents (doc_id, text).

    extract takes a text and gives its concepts and its relations (concept, kind, concept). Every mention has an id of its own; a relation
    counts if both its concepts are mentioned in the document.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                named, related = extract(t) if isinstance(t, str) else ([], [])
                clean = [re.sub(r"\s+", " ", n).strip() for n in named]
                out += [(i, n, None, None) for n in dict.fromkeys(clean) if n]
                out += [(i, a, k, b) for a, k, b in related if a in clean and b in clean]
            yield pd.DataFrame(out, columns=["doc_id", "concept", "kind", "other"])

    rows = documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, concept string, kind string, other string")
    key = lambda c: uuid5(F.concat(F.lit("concept:"), F.col("doc_id").cast("string"), F.lit(":"), F.col(c)))
    return rows.where("kind is null").select("doc_id", key("concept").alias("concept_id"), "concept"), rows.where("kind is not null").select("doc_id", key("concept").alias("from"), key("other").alias("to"), "kind")


def catalog_tables(columns: DataFrame) -> DataFrame:
    """(table_name, columns): a catalogue's columns (table_name, position, column_name, data_type) as one JSON list a table, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name", "data_type"))), lambda c: F.struct(c["column_name"].alias("name"), c["data_type"].alias("data_type")))
    return columns.groupBy("table_name").agg(F.to_json(listed).alias("columns"))


def canonical_text(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
