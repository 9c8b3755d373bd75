"""Readers: file trees, documents, e-mail, HTML, DOCX, commits, exported records, catalogues, batches of a graph; nothing is fetched over a network.

Each gives a lazy DataFrame; a reader of files lists and reads them on the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom.functions import text

IGNORED = [".git", "target", "node_modules", "__pycache__"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_tree(spark: SparkSession, root: str, glob: str = "*", ignored: list[str] = IGNORED) -> DataFrame:
    """(path, size_bytes, sha256, modified, excerpt, symbols) of the files under root: no ignored components, no secret files, texts redacted."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root if root.startswith("file:") else f"file:{root}"
    path = F.ltrim(F.regexp_replace("path", "^" + re.escape(base.rstrip("/")), ""), F.lit("/"))
    body = F.try_to_binary(F.hex("content"), F.lit("hex"))
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    clean = text.redacted(decoded)
    out = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.sha2(body, 256).alias("sha256"), F.col("modificationTime").alias("modified"), text.excerpt(clean).alias("excerpt"), text.symbols(clean).alias("symbols"))
    return out.where(~text.is_ignored(F.col("path"), ignored) & ~text.is_secret_file(F.col("path")))


def fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): one hash over (path, size, modified) of all files, the same in any order. Hashes are combined in parts by their first letters."""
    one = files.select(F.sha2(F.concat_ws("|", "path", "size_bytes", "modified"), 256).alias("h"))
    parts = one.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    return parts.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.concat("p", "h")))), 256).alias("fingerprint"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str) -> str:
    """The visible text of a page, blocks on lines of their own."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(p.out).split("\n"))
    return "\n".join(line for line in lines if line)


def email_text(raw: bytes) -> str:
    """Headers, a blank line, and the text part, else the HTML part as text."""
    m = message_from_bytes(raw, policy=policy.default)
    head = "\n".join(f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if m[h])
    part = m.get_body(("plain",))
    if part is not None:
        return f"{head}\n\n{part.get_content().strip()}"
    part = m.get_body(("html",))
    return f"{head}\n\n{html_text(part.get_content()) if part is not None else ''}"


@F.pandas_udf(T.StringType())
def html_texts(pages: pd.Series) -> pd.Series:
    """html_text of a column."""
    return pd.Series([html_text(p) if isinstance(p, str) else None for p in pages])


@F.pandas_udf(T.StringType())
def email_texts(raws: pd.Series) -> pd.Series:
    """email_text of a column of texts."""
    return pd.Series([email_text(r.encode("utf-8")) if isinstance(r, str) else None for r in raws])


def docx_text(raw: bytes) -> str:
    """Paragraphs and table rows of a document, one a line, cells parted by tabs."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    say = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            out.append(say(e))
        elif e.tag == f"{_W}tbl":
            out += ["\t".join(say(c) for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr")]
    return "\n".join(line for line in out if line.strip())


def read_document(path: str, raw: bytes) -> str | None:
    """The text of a txt, md, html, eml or docx file; None for others and for what cannot be read (scans and PDF need tools that are not here)."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind in ("html", "htm"):
            return html_text(raw.decode("utf-8", "replace"))
        if kind == "eml":
            return email_text(raw)
        if kind == "docx":
            return docx_text(raw)
        return raw.decode("utf-8") if kind in ("txt", "md") else None
    except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ET.ParseError, LookupError):
        return None


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, sections): local documents without invisible characters, in sections."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [read_document(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    clean = raw.mapInPandas(run, "path string, text string").where("text is not null").select("path", text.redacted(text.sanitized(F.col("text"))).alias("text"))
    return clean.withColumn("sections", text.chunks(F.col("text")))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit records of JSON lines."""
    return spark.read.schema("sha string, repo string, author_name string, author_email string, commit_date timestamp_ntz, message string, files_changed array<string>, insertions int, deletions int").json(path)


def git_log(lines: str) -> list[dict]:
    """Commits of `git log --numstat --format=%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s`."""
    out = []
    for record in lines.split("\x1e")[1:]:
        head, _, rest = record.partition("\n")
        sha, name, mail, date, message = head.split("\x1f")
        stats = [m.groups() for m in re.finditer(r"(?m)^(\d+|-)\t(\d+|-)\t(.+)$", rest)]
        number = lambda x: 0 if x == "-" else int(x)
        out.append({"sha": sha, "author_name": name, "author_email": mail, "date": date, "message": message, "files_changed": [f for *_, f in stats], "insertions": sum(number(a) for a, *_ in stats), "deletions": sum(number(d) for _, d, _ in stats)})
    return out


def git_logs(logs: DataFrame) -> DataFrame:
    """The commits of logs (repo, log), each the output that git_log reads."""
    columns = ["repo", "sha", "author_name", "author_email", "date", "message", "files_changed", "insertions", "deletions"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"repo": repo, **c} for repo, log in zip(pdf["repo"], pdf["log"]) if isinstance(log, str) for c in git_log(log)], columns=columns)

    return logs.select("repo", "log").mapInPandas(run, "repo string, sha string, author_name string, author_email string, date string, message string, files_changed array<string>, insertions bigint, deletions bigint")


def repository_records(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo, head_branch, remotes, author_name, n_commits): each repository's contributors with their distinct commits; repositories without commits have one row without a contributor."""
    one = commits.where("sha is not null and author_name is not null").select("repo", "sha", "author_name").distinct().groupBy("repo", "author_name").agg(F.count(F.lit(1)).alias("n_commits"))
    return repositories.select("repo", "head_branch", F.array_join("remotes", ",").alias("remotes")).join(one, "repo", "left").select("repo", "head_branch", "remotes", "author_name", F.coalesce("n_commits", F.lit(0)).alias("n_commits"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files (path, sha256, ...) that known (path, sha256) lacks or has with another hash: what a build has to read again."""
    return files.join(known.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")


def gate(files: DataFrame, last: str | None) -> tuple[bool, str]:
    """(whether anything changed since a fingerprint, the new one): a source whose fingerprint is the last one is skipped whole."""
    now = fingerprint(files).collect()[0]["fingerprint"]
    return now != last, now


def write_model(model: DataFrame, path: str) -> None:
    """The canonical model as one JSON text an object, in files compressed with zstd."""
    model.select(F.to_json(F.struct(*model.columns)).alias("value")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_model(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path).select(F.from_json("value", schema).alias("v")).select("v.*")


def issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("owner string, repo string, number bigint, title string, body string, state string, is_pull_request boolean, files_changed array<string>").json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, parent_id string, title string, body string").json(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Columns of catalogue exports of any warehouse: (source_system, table_name, position, column_name, data_type, engine, order_by, partition_by); the keys and the engine are null where a warehouse has none."""
    return spark.read.schema("source_system string, table_name string, position int, column_name string, data_type string, engine string, order_by array<string>, partition_by array<string>").json(path)


def graph_batch(spark: SparkSession, root: str, name: str, batch: str | None = None) -> DataFrame:
    """A table of the latest batch_id=... folder under root, or of a given one; other batches are not read."""
    all_batches = spark.read.option("basePath", root).option("pathGlobFilter", f"{name}*.parquet").option("recursiveFileLookup", False).parquet(f"{root}/batch_id=*")
    if batch is None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = [s.getPath().getName() for s in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)]
        batch = max(n.split("=", 1)[1] for n in found if n.startswith("batch_id="))
    return all_batches.where(F.col("batch_id").cast("string") == batch)
