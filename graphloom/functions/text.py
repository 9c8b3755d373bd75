"""Text functions as Column expressions: excerpts, symbols, sanitising, redaction, slugs, names, references, paths and chunks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of secrets with their labels, in the order they are applied.
SECRETS = [
    ("aws-access-key-id", r"AKIA[0-9A-Z]{16}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack-token", r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    ("google-api-key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("stripe-key", r"sk_(live|test)_[0-9a-zA-Z]{16,}"),
    ("private-key-block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    ("generic-assigned-secret", r"""(?i)(api[_-]?key|secret|passwd|password|access[_-]?key|auth[_-]?token)\s*[:=]\s*['"]?[A-Za-z0-9/+_\-]{8,}['"]?"""),
]
# Names of files that hold secrets.
SECRET_FILES = [
    ".env", ".env.*", "*.pem", "*.key", "*.pfx", "*.p12", "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "*.ppk", "credentials", "credentials.json",
    ".npmrc", ".netrc", ".pgpass", "*.jks", "*.keystore",
]
# What stands for invisible text.
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{E0000}-\x{E007F}]"
# Words that close an issue, and technologies by what mentions them.
CLOSING = ["close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved"]
TECHNOLOGIES = {
    "PostgreSQL": ["postgres://", "postgresql://", "psycopg2", "pg8000", "org.postgresql", "require('pg')", 'require("pg")', "from 'pg'", 'from "pg"'],
    "MySQL": ["mysql://", "pymysql", "mysql2", "com.mysql"],
    "MongoDB": ["mongodb://", "mongodb+srv://", "pymongo", "mongoose"],
    "Redis": ["redis://", "ioredis", "require('redis')", 'require("redis")', "import redis"],
    "Kafka": ["kafka-python", "org.apache.kafka", "kafkajs"],
}
EXCERPT = 600


def excerpt(text: Column, n: int = EXCERPT) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def symbols(text: Column, most: int = 50) -> Column:
    """Names declared at the start of a line, in order, at most so many."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?mU)^\s*(?:fn |def |class |func |interface )(\w+)"), F.lit(1)), 1, most)


def sanitized(text: Column) -> Column:
    """Text without zero-width characters and the tag block."""
    return F.regexp_replace(text, INVISIBLE, "")


def n_sanitized(text: Column) -> Column:
    """How many characters sanitized removes."""
    return F.char_length(text) - F.char_length(sanitized(text))


def redacted(text: Column, extra: list[tuple[str, str]] = ()) -> Column:
    """Text with each secret replaced by [REDACTED:label]; extra patterns come after the fixed ones."""
    for label, pattern in [*SECRETS, *extra]:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{label}]")
    return text


def glob_regex(glob: str) -> str:
    """A glob as a whole-string regular expression: * and ? match any characters, others themselves."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c for c in glob) + "$"


def is_secret_file(path: Column, extra: list[str] = ()) -> Column:
    """True if the file name or the whole path matches a glob of secret files."""
    name = F.substring_index(path, "/", -1)
    out = F.lit(False)
    for g in [*SECRET_FILES, *extra]:
        out = out | name.rlike(glob_regex(g)) | path.rlike(glob_regex(g))
    return out


def is_ignored(path: Column, components: list[str]) -> Column:
    """True if a component of the path is in the list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(c) for c in components])) if components else F.lit(False)


def snake_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def kebab_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def type_family(data_type: Column) -> Column:
    """integer, string, datetime, numeric, boolean by the first substring found in this order, else the lower-cased type; interval and point count as integer."""
    t = F.lower(data_type)
    return (
        F.when(t.contains("int"), "integer")
        .when(t.rlike("char|text|string"), "string")
        .when(t.rlike("date|time"), "datetime")
        .when(t.rlike("numeric|decimal|float|double"), "numeric")
        .when(t.contains("bool"), "boolean")
        .otherwise(t)
    )


def concept(text: Column) -> Column:
    """White space collapsed, case kept."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lexical_path(path: Column) -> Column:
    """A path with . and empty parts dropped and .. taking back the part before it; leading .. stay."""
    step = lambda acc, p: (
        F.when((p == ".") | (p == ""), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def json_attributes(text: Column) -> Column:
    """The fields of a JSON object as text; an empty map for anything else."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def normalized_name(name: Column) -> Column:
    """Lower case; _ - . as blanks; table affixes stripped until none is left; blanks collapsed.

    A leading table or tbl goes without a word boundary, so tableau becomes au.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[_.-]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(s, r"^(?:table ?|tbl ?)+(?=.)|(?:(?: table| tbl| dim| fact)+)$", ""))


def cross_system_name(name: Column) -> Column:
    """The part after the last dot, normalised, without warehouse affixes as whole words."""
    words = F.split(normalized_name(F.substring_index(name, ".", -1)), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("mstr", "stg", "raw", "dim", "fact", "tbl")), " ")


def comparable_name(name: Column, kind: Column) -> Column:
    """What identity compares: of a table the part after the last dot (not for paths), of an issue or pull request its title."""
    title = F.regexp_extract(name, r"^[^#]*#[^:]*?: (.*)$", 1)
    return (
        F.when((kind == "Table") & ~name.contains("/"), F.substring_index(name, ".", -1))
        .when(kind.isin("Issue", "PullRequest") & (title != ""), title)
        .otherwise(name)
    )


def closed_issues(body: Column) -> Column:
    """Numbers after a closing word and #, in any case and also within longer words, ascending and distinct."""
    found = F.regexp_extract_all(F.lower(body), F.lit(r"(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?) #(\d{1,9})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("bigint"))))


def mentioned_issues(body: Column) -> Column:
    """All #n, ascending and distinct, those that body closes left out."""
    found = F.regexp_extract_all(body, F.lit(r"#(\d{1,9})"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(F.transform(found, lambda x: x.cast("bigint"))), closed_issues(body)))


def technologies(text: Column) -> Column:
    """The technologies a text obviously mentions, sorted."""
    low = F.lower(text)
    hits = []
    for name, patterns in TECHNOLOGIES.items():
        any_of = F.lit(False)
        for p in patterns:
            any_of = any_of | low.contains(p)
        hits.append(F.when(any_of, F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*hits)))


def linked_titles(body: Column) -> Column:
    """Distinct non-empty titles of content-title="..." in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r'content-title="([^"]+)"'), F.lit(1)))


def chunks(text: Column, budget: int = 2500, most: int = 300) -> Column:
    """Sections of whole lines of at most budget characters, a newline counting one; longer lines are cut; blank sections are dropped."""
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.when(F.char_length(line) <= budget, F.array(line)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.char_length(line) - 1) / budget).cast("int")), lambda i: F.substring(line, i * budget + 1, F.lit(budget))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        joined = F.concat(acc["open"], F.lit("\n"), piece)
        fits = F.char_length(joined) <= budget
        return F.struct(
            F.when(acc["open"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(acc["open"].isNull() | ~fits, piece).otherwise(joined).alias("open"),
        )

    folded = F.aggregate(pieces, start, add, lambda acc: F.concat(acc["done"], F.array_compact(F.array(acc["open"]))))
    return F.slice(F.filter(folded, lambda s: s.rlike(r"\S")), 1, most)
