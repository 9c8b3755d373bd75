"""Source files that do not parse (problem 4).

Each file is lexed for the language of its extension and the token stream is parsed with memoised derivatives: the token at which the
derivative is empty is the one at fault, and a language that is not nullable at the end says the file is cut short. TOML is then
checked for keys and tables defined twice.

Scale: one narrow pass without a shuffle, file by file; what a Python worker remembers of the derivatives is shared by its files and bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.derivatives import Grammar

from graphloom.llm.languages import ERROR, LANGUAGES, toml_redefinition
from graphloom.session import spread

_GRAMMARS: dict[str, Grammar] = {}


def check(extension: str, source: str) -> tuple[str, int, int] | None:
    """None for valid syntax, else (kind of error, index of the token at fault, its line); kinds are lexical, syntax, truncated and redefined."""
    name, lex, rules, start = LANGUAGES[extension]
    if name not in _GRAMMARS:
        _GRAMMARS[name] = Grammar(rules, start)
    grammar = _GRAMMARS[name]
    kinds, at = lex(source)
    classes = grammar.classes
    bad = grammar.parse([classes.get(k, 0) for k in kinds])
    line = lambda k: source.count("\n", 0, at[k]) + 1 if k < len(at) else source.count("\n") + 1
    if bad < 0:
        if name == "toml" and (twice := toml_redefinition(source, kinds, at)) >= 0:
            return "redefined", twice, line(twice)
        return None
    if bad == len(kinds):
        return "truncated", bad, line(bad)
    return "lexical" if kinds[bad] == ERROR else "syntax", bad, line(bad)


def language(path: Column) -> Column:
    """rust, python, json or toml by the path's extension in any case; null for others."""
    e = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for extension, (name, *_) in LANGUAGES.items():
        out = F.when(e == extension, name).otherwise(out)
    return out


def parse_errors(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, language, error, token, line): files whose source is not null and not valid in their language.

    Every row counts by itself. An empty source is valid but in JSON. Files of other languages, null sources and null paths have no rows here; extra
    columns are ignored.
    """
    extension = {name: e for e, (name, *_) in LANGUAGES.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if found := check(extension[row.language], row.source):
                    out.append((row.file_id, row.repo, row.path, row.language, *found))
            yield pd.DataFrame(out, columns=["file_id", "repo", "path", "language", "error", "token", "line"])

    known = files.select("file_id", "repo", "path", language(F.col("path")).alias("language"), "source").where("language is not null and source is not null")
    return spread(known).mapInPandas(run, "file_id bigint, repo string, path string, language string, error string, token bigint, line bigint")


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, rate) over files with a source."""
    n = files.select("repo", language(F.col("path")).alias("language"), "source").where("language is not null and source is not null").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"))
    bad = parse_errors(files).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_broken"))
    n, bad = n.alias("n"), bad.alias("b")
    same = F.col("n.repo").eqNullSafe(F.col("b.repo")) & (F.col("n.language") == F.col("b.language"))
    broken = F.coalesce(F.col("n_broken"), F.lit(0))
    return n.join(bad, same, "left").select("n.repo", "n.language", "n_files", broken.alias("n_broken"), F.round(broken / F.col("n_files"), 6).alias("rate"))
