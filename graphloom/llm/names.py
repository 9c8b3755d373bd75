"""Variant spellings of names typed by people (problem 1).

Every row (name, address) is read into an entity node: an address of one person, an organisation, or a loose spelling (no address, a
shared mailbox or a forge's no-reply address). Equal keys make equal nodes. Unequal spellings meet through MinHash bands over
padded q-grams, with as many bands as the collision curve asks for the wanted recall, and are verified by
Monge-Elkan similarity of their tokens together with the evidence of their addresses. Verified links are clustered by star clustering,
repeated on the stars until none is linked to another.

Scale: bands are built over distinct spellings, never over rows; bands of spellings of people are split by address domain or
given name; a bucket of more than BUCKET spellings is split into blocks that meet block against block. Copies are linked to one representative.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.session import cut

Q = 2
ROWS = 3
RECALL = 0.97
SIMILARITY = 0.5
BUCKET = 200
#: Names and organisations may differ by 2 edits, each of which, a swap of letters, may be 2 insertions, deletions or replacements.
CORE_EDITS = 4
STAR_LINKS = 200_000
NAME_ENOUGH = 0.88
SEED = 11

# Decorations people and tools add to names, names that stand for nobody, mailboxes of teams.
TITLES = {"dr", "ing", "m.sc", "msc", "prof", "mr", "mrs", "ms", "dipl", "phd", "b.sc", "bsc"}
NOBODY = {"", "root", "ubuntu", "unknown", "your name", "none", "null", "n/a", "na", "admin", "user", "nobody", "anonymous", "name", "test", "-"}
SHARED = {"platform", "dev-team", "noreply", "no-reply", "build", "team", "dev", "admin", "support", "root", "devops"}
ORG_MAILBOXES = {"info", "release", "opensource", "bot", "ci"}
LEGAL = {"gmbh", "inc", "incorporated", "ltd", "limited", "llc", "l.l.c", "sa", "s.a", "bv", "b.v", "ag", "corp", "gesellschaft", "mbh", "the", "team", "plc", "co"}
SECTORS = {"systems", "robotics", "networks", "data", "logistics", "software", "analytics", "research", "energy", "instruments"}
PARTICLES = {"van", "der", "de", "von", "den", "al", "la", "le", "di", "da", "del", "zu", "ter"}
# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander", "anneliese": "anne lise anni", "anthony": "tony ant", "antonia": "toni", "benjamin": "ben benny",
    "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "dmitri": "dima dmitriy dmitry mitya", "dolores": "lola",
    "edward": "ed eddie ned ted", "elizabeth": "liz beth betty eliza lisa", "francisco": "paco pancho curro", "frederick": "fred freddy", "giuseppe": "beppe peppe pino",
    "gregory": "greg", "henry": "harry hank", "james": "jim jimmy jamie", "johannes": "hannes hans jo", "jose": "pepe", "joseph": "joe joey", "katarzyna": "kasia kaska",
    "katherine": "kate kathy katie kathryn", "malgorzata": "gosia malgosia", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick", "nicholas": "nick",
    "olamide": "ola", "patricia": "pat patty trish", "philippa": "pippa", "rebecca": "becky becca", "richard": "dick rick rich richie", "robert": "bob rob bobby",
    "samantha": "sam sammy", "stephen": "steve steven", "susanne": "susi sanne susan", "tatiana": "tanya tania", "theodora": "thea dora", "thomas": "tom tommy",
    "vladimir": "vova volodya vlad", "wilhelmina": "mina willa minnie", "william": "bill will billy", "yusuf": "youssef yousef yusef", "tomasz": "tomek", "mateus": "matheus",
}
GIVEN = {short: name for name, shorts in NICKNAMES.items() for short in shorts.split()}
_DECORATION = re.compile(r"\((?:contractor|ext|extern|external)\)|\[(?:ext|contractor|external)\]|\s-\s*on leave|\|.*$|[\U0001F000-\U0001FAFF☀-➿️]", re.I)
_UNDECOMPOSED = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})


def unmangled(s: str) -> str:
    """Text whose UTF-8 was read as Latin-1 or CP1252, put right."""
    if re.search("[Ã-ÅÐÑ]", s):
        for codec in ("cp1252", "latin-1"):
            try:
                return s.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    return s


def folded(s: str) -> str:
    """Lower case without accents, format characters and repeated blanks."""
    if s.isascii() and s.isprintable():
        return re.sub(r"\s+", " ", s.lower()).strip()
    s = "".join(" " if unicodedata.category(c) == "Zs" else c for c in unmangled(s) if unicodedata.category(c) not in ("Cf", "Cc"))
    s = unicodedata.normalize("NFKD", s.lower().translate(_UNDECOMPOSED))
    return re.sub(r"\s+", " ", "".join(c for c in s if not unicodedata.combining(c))).strip()


def address_parts(e: str | None) -> tuple[str, str, str] | None:
    """(local, domain without its last label, kind), kind one of personal, shared, org, noreply; None where there is no address."""
    m = re.fullmatch(r"\s*<?([^@\s<>]+)@([^@\s<>]+?)\.?>?\s*", e.lower()) if e else None
    if not m:
        return None
    local, domain = m.group(1), m.group(2).rsplit(".", 1)[0]
    if "noreply" in domain:
        return re.sub(r"^\d+\+", "", local), domain, "noreply"
    local = local.split("+", 1)[0]
    return local, domain, "org" if local in ORG_MAILBOXES else "shared" if local in SHARED else "personal"


def name_words(text: str) -> list[str]:
    """The words of a decorated name, folded, without titles and decorations; 'B, A' becomes 'A B', as does 'B A' where only B is upper case."""
    raw = _DECORATION.sub(" ", unmangled(text))
    if "," in raw:
        a, _, b = raw.partition(",")
        raw = f"{b} {a}"
    elif " " not in re.sub("[\xa0​]", " ", raw).strip():
        raw = re.sub(r"(?<=[a-zà-ÿ.])(?=[A-ZÀ-Þ])", " ", raw)
    upper_first = re.match(r"^\s*((?:[^\W\d_]|['-])+(?:\s+(?:[^\W\d_]|['-])+)*?)\s+([^\W\d_][\w'’-]*)\s*$", raw)
    if upper_first and upper_first.group(1).isupper() and len(upper_first.group(1)) > 2 and not upper_first.group(2).isupper():
        raw = f"{upper_first.group(2)} {upper_first.group(1)}"  # SURNAME Given
    words = [w for w in re.split(r"[\s_.]+", re.sub(r"\b(m\.sc|b\.sc)\.?", " ", folded(raw))) if w.strip("-'")]
    words = [re.sub(r"[^a-z-]", "", w) for w in words if w not in TITLES]
    return [w for w in words if w.strip("-")]


def person_name(text: str, given_names: frozenset[str] = frozenset()) -> tuple[str, str, str]:
    """(given, surname, middle initial) of a decorated name, given names in their long form.

    Surnames keep their particles, joined. A last word that is a usual given name comes first if the first word is none.
    """
    words = name_words(text)
    if not words:
        return "", "", ""
    usual = lambda w: w in given_names or w in GIVEN or w in NICKNAMES
    given, rest, middle = words[0], words[1:], ""
    if rest and not usual(given) and usual(rest[-1]):
        given, rest = rest[-1], [given, *rest[:-1]]
    elif len(rest) > 1 and not usual(given) and len(rest[-1]) == 1 and usual(rest[-2]):
        given, rest, middle = rest[-2], [given, *rest[:-2]], rest[-1]
    while len(rest) > 1 and len(rest[0]) == 1:
        middle, rest = rest[0], rest[1:]
    return GIVEN.get(given, given), "".join(rest).replace("-", ""), middle


def organisation(name: str, address: tuple[str, str, str] | None) -> str | None:
    """The organisation's own words, joined, if the row stands for one: from its address, else from a name with a sector or legal form."""
    if address and address[2] == "org":
        return re.sub("[^a-z]", "", address[1])
    if address and address[2] != "noreply":
        return None
    words = re.findall(r"[a-z.]+", folded(name or ""))
    shorts = {w[:3] for w in SECTORS}
    legal = [w for w in words if w.rstrip(".") in LEGAL]
    sector = [w for w in words if w in SECTORS or (w.endswith(".") and w[:-1] in shorts)]
    if not sector or len(words) < 2 or not (legal or any(w in SECTORS for w in words)):
        return None
    return "".join(re.sub("[^a-z]", "", w) for w in words if w not in sector and w not in legal) or None


@lru_cache(200_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with Winkler's bonus for a common prefix of up to four letters."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken, left, right = [False] * m, [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    right = [b[j] for j in range(m) if taken[j]]
    k = len(left)
    if not k:
        return 0.0
    turned = sum(x != y for x, y in zip(left, right)) / 2
    j = (k / n + k / m + (k - turned) / k) / 3
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return j + 0.1 * prefix * (1 - j)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean best Jaro-Winkler similarity of each word with the other side's words, the smaller of both directions."""
    if not a or not b:
        return 0.0
    one = lambda x, y: sum(max(jaro_winkler(u, v) for v in y) for u in x) / len(x)
    return min(one(a, b), one(b, a))


@lru_cache(200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edits with transpositions between a and b; most + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        nxt = [i]
        for j, d in enumerate(b, 1):
            cost = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (c != d))
            if before and i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, before[j - 2] + 1)
            nxt.append(cost)
        before, row = row, nxt
    return min(row[-1], most + 1)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows whose collision curve 1 - (1 - s^rows)^bands reaches recall at this similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(text: str, q: int = Q) -> list[str]:
    """Padded q-grams of each word."""
    out = []
    for w in text.split(" "):
        padded = "^" * (q - 1) + w + "$" * (q - 1)
        out += [padded[i : i + q] for i in range(len(padded) - q + 1)]
    return out


_PRIME = (1 << 31) - 1


def band_keys(texts: list[str], bands: int, rows: int) -> list[list[int]]:
    """The key of each band of each text."""
    rng = np.random.default_rng(SEED)
    n = bands * rows
    # four draws more than used, so that the bands are those of earlier results
    mul, add = rng.integers(1, _PRIME, n + 4, dtype=np.int64)[:n], rng.integers(0, _PRIME, n + 4, dtype=np.int64)[:n]
    weights = np.array([1_000_003**i % _PRIME for i in range(rows)], np.int64)
    known: dict[str, int] = {}
    at: dict[str, int] = {}
    texts_grams = [sorted(set(grams(t))) for t in texts]
    for g in {g for gs in texts_grams for g in gs}:
        at[g] = len(known)
        known[g] = _code(g)
    codes = np.array(list(known.values()), np.int64)
    hashed = (codes[:, None] % _PRIME * mul[None, :] % _PRIME + add[None, :]) % _PRIME  # each gram's hashes, once a batch
    out: list[list[int]] = []
    for lo in range(0, len(texts), 2000):
        part = texts_grams[lo : lo + 2000]
        flat = np.array([at[g] for gs in part for g in gs], np.int64)
        starts = np.concatenate([[0], np.cumsum([len(gs) for gs in part])[:-1]])
        low = np.minimum.reduceat(hashed[flat], starts, axis=0)
        out += (low.reshape(len(part), bands, rows) % 65_521 * weights).sum(axis=2).tolist()
    return out


def _code(gram: str) -> int:
    h = 2_166_136_261
    for b in gram.encode("utf-8"):
        h = (h ^ b) * 16_777_619 & 0x7FFFFFFF
    return h % 46_337


def similar_spellings(spellings: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """(view, left, right): ids of different spellings of one view that share a band within their block.

    spellings has (view, block, id, text, is_left, is_right), one row a spelling, or one as left and one as right. Buckets of more than bucket spellings
    are dealt into blocks of about that size, and each two blocks meet in a group of their own, so that no pair is lost.

    Bands, buckets and pairs hold numbers in place of the spellings; a bucket is shuffled once, and a pair is met in one direction. Where spellings
    has core (string), pairs whose cores are both there and over CORE_EDITS insertions, deletions and replacements apart are left out as soon as they meet.
    """
    bands = bands_for(similarity, recall, rows)

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series(band_keys(texts.tolist(), bands, rows))

    core = F.col("core") if "core" in spellings.columns else F.lit(None).cast("string").alias("core")
    known = cut(spellings.select("view", "id", "is_left", "is_right", core, F.monotonically_increasing_id().alias("n"), F.xxhash64("view", "block").alias("block"), keys("text").alias("k")))
    sides = (F.col("is_left").cast("int") + 2 * F.col("is_right").cast("int")).alias("sides")
    banded = known.select("n", sides, "core", "block", F.posexplode("k").alias("band", "key")).select(F.xxhash64("block", "band", "key").alias("bucket"), "n", "sides", "core")
    sized = banded.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("bucket")))  # a spelling alone in its bucket meets nobody
    mine = F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")
    cells = (
        sized.where(F.col("size") > bucket).withColumn("parts", F.ceil(F.col("size") / bucket).cast("int")).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "n", "sides", "core", "mine", (F.col("mine") == F.col("other")).alias("own"))
    )
    group = lambda df: df.groupBy("bucket").agg(F.collect_list(F.struct("n", "sides", "core", "mine", "own")).alias("all"))
    small = sized.where((F.col("size") > 1) & (F.col("size") <= bucket)).select("bucket", "n", "sides", "core", F.lit(0).alias("mine"), F.lit(True).alias("own"))
    two = group(small).unionByName(group(cells)).select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    meet = ((F.col("x.sides").bitwiseAND(1) > 0) & (F.col("y.sides") > 1)) | ((F.col("y.sides").bitwiseAND(1) > 0) & (F.col("x.sides") > 1))
    two = two.where((F.col("x.n") < F.col("y.n")) & (F.col("x.own") | (F.col("x.mine") != F.col("y.mine"))) & meet)
    pairs = two.where(F.coalesce(F.levenshtein("x.core", "y.core", CORE_EDITS) >= 0, F.lit(True))).select(F.col("x.n").alias("x"), F.col("y.n").alias("y")).distinct()
    end = lambda c: known.select(F.col("n").alias(c), "view", F.struct("id", "is_left", "is_right").alias(f"of_{c}"))
    named = pairs.join(end("x").hint("merge"), "x").join(end("y").drop("view").hint("merge"), "y")
    way = lambda a, b: F.when(F.col(f"{a}.is_left") & F.col(f"{b}.is_right"), F.struct(F.col(f"{a}.id").alias("left"), F.col(f"{b}.id").alias("right")))
    return named.select("view", F.explode(F.array(way("of_x", "of_y"), way("of_y", "of_x"))).alias("p")).where("p.left <> p.right").select("view", "p.left", "p.right")


_ROW = "author_id bigint, node string, kind string, given string, surname string, middle string, local string, domain string, keys array<string>"
#: A word that begins this share of all names is a usual given name; so there are no more than 1 / GIVEN_SHARE of them.
GIVEN_SHARE = 0.001


def usual_given_names(authors: DataFrame, share: float = GIVEN_SHARE) -> frozenset[str]:
    """The words that begin at least this share of the names of several words, and end fewer."""

    @F.pandas_udf("array<string>")
    def ends(names: pd.Series) -> pd.Series:
        return pd.Series([[w[0], w[-1]] if isinstance(n, str) and len(w := name_words(n)) > 1 else [] for n in names])

    words = authors.select(ends("author_name").alias("w")).where("size(w) = 2").select(F.posexplode("w").alias("at", "word"))
    n = words.groupBy("word").agg(F.sum(1 - F.col("at")).alias("first"), F.sum("at").alias("last"))
    total = authors.count()
    return frozenset(r["word"] for r in n.where((F.col("first") >= max(3, share * total)) & (F.col("first") > 2 * F.col("last"))).collect() if len(r["word"]) > 1)


def read_rows(authors: DataFrame) -> DataFrame:
    """What each row says: its node, kind (address, loose, org, nobody), name parts, address parts and keys that alone identify."""

    usual = usual_given_names(authors)

    def run(batches):
        for pdf in batches:
            out = []
            for i, name, mail in zip(pdf["author_id"], pdf["author_name"], pdf["author_email"]):
                name = name if isinstance(name, str) else ""
                address = address_parts(mail if isinstance(mail, str) else None)
                inner = address_parts(name)
                org = organisation(name, address)
                if org:
                    out.append((i, f"org:{org}", "org", "", "", "", org, "", []))
                    continue
                plain = folded(_DECORATION.sub(" ", name))
                given, surname, middle = ("", "", "") if plain in NOBODY or inner else person_name(name, usual)
                keys = [f"address:{inner[0]}@{inner[1]}"] if inner and inner[2] == "personal" else []
                if not surname and len(given) > 4 and given not in NICKNAMES and given not in usual and not inner:
                    keys.append(f"handle:{plain}")
                if address and address[2] == "personal":
                    local, domain, _ = address
                    out.append((i, f"address:{local}@{domain}", "address", given, surname, middle, local, domain, keys))
                    continue
                local, domain = (address[0], address[1]) if address else ("", "")
                if address and address[2] == "noreply":
                    keys.append(f"handle:{local}")
                if not (surname or keys):
                    out.append((i, f"row:{i}", "nobody", "", "", "", "", "", []))
                    continue
                shown = domain if address and address[2] == "shared" else local
                node = f"loose:{address[2] if address else 'none'}:{shown}:{given} {middle} {surname}" if surname else f"loose:{keys[0]}"
                out.append((i, node, "loose", given, surname, middle, local, "" if not address or address[2] == "noreply" else domain, keys))
            yield pd.DataFrame(out, columns=["author_id", "node", "kind", "given", "surname", "middle", "local", "domain", "keys"])

    return authors.select("author_id", "author_name", "author_email").mapInPandas(run, _ROW)


def same_given(a: str, b: str) -> bool:
    """Given names that may be one person's: equal, an initial of the other, or one typing error or two in a long name."""
    if not a or not b or a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    return edits(a, b, 2) <= (1 if min(len(a), len(b)) < 6 else 2)


def local_names(local: str) -> tuple[str, str] | None:
    """(first, last) of a local part such as first.last or first_last."""
    parts = [p for p in re.split(r"[._]", local) if p]
    if len(parts) >= 2 and len(parts[0]) > 1 and not any(c.isdigit() for c in local):
        return GIVEN.get(parts[0], parts[0]), parts[-1].replace("-", "")
    return None


_MIDDLE = r"^[a-z]{2,}\.([a-z])\.[a-z.-]{2,}$"


def middle_of(local: str) -> str:
    """The middle initial of first.m.last, by which namesakes tell their addresses apart."""
    m = re.fullmatch(_MIDDLE, local)
    return m.group(1) if m else ""


def verify_addresses(a: tuple, b: tuple) -> float:
    """How sure two addresses (local, domain, given, surname) are one person's; 0 if not enough.

    The locals must be one spelling, or one of them must spell the name out, or the domains must be one; the names must agree by Monge-Elkan, those an
    address spells out standing in for a missing name.
    """
    (la, da, ga, sa), (lb, db, gb, sb) = a, b
    ga, sa = (ga, sa) if ga or sa else local_names(la) or (ga, sa)
    gb, sb = (gb, sb) if gb or sb else local_names(lb) or (gb, sb)
    if not same_given(ga, gb) or (middle_of(la) and middle_of(lb) and middle_of(la) != middle_of(lb)):
        return 0.0
    d = edits(la, lb, 2)
    digits = any(c.isdigit() for c in la)
    if d == 0 and digits and ga and gb:
        return 1.0
    near = d == 0 or (da == db and d <= 2 and len(la) > 5)
    me = monge_elkan([ga, sa], [gb, sb]) if sa and sb and ga and gb else 0.0
    if sa and sb and edits(sa, sb, 3) > (2 if near else 1):
        return 0.0
    if near:
        return me if me >= 0.85 else (0.9 if d == 0 and not (sa and sb) else 0.0)
    if me >= 0.93 and (spelled(la, gb, sb) or spelled(lb, ga, sa) or spelled(la, ga, sa) or spelled(lb, gb, sb) or da == db):
        return me
    return 0.0


def spelled(local: str, given: str, surname: str) -> bool:
    """Whether a local part is first.last of this name, nicknames and a typing error apart."""
    n = local_names(local)
    return bool(n and "." in local and same_given(n[0], given) and edits("".join(re.split(r"[._]", local)[1:]).replace("-", ""), surname, 2) <= 1)


def close_names(a: str, b: str) -> float:
    """How alike two names of a given name and a surname are; 0 where neither addresses nor loose spellings of them could agree but by an equal local part."""
    (ga, _, sa), (gb, _, sb) = a.partition(" "), b.partition(" ")
    if not same_given(ga, gb) or edits(sa, sb, 3) > (2 if min(len(sa), len(sb)) > 6 else 1):
        return 0.0
    me = monge_elkan([ga, sa], [gb, sb])
    return me if me >= NAME_ENOUGH else 0.0


def verify_loose(kind: str, loose: tuple, known: tuple) -> float:
    """How sure a loose spelling (local, domain, given, surname) is the person of an address; 0 if not enough."""
    (ll, dl, gl, sl, ml), (la, da, ga, sa) = loose, known
    mine = middle_of(la)
    if mine and ml and mine != ml:
        return 0.0
    if not sl or not sa or not gl or not ga or not same_given(gl, ga):
        return 0.0
    wrong = edits(sl, sa, 3)
    if wrong > (2 if len(sa) > 6 else 1):
        return 0.0
    me = monge_elkan([gl, sl], [ga, sa])
    if len(gl) == 1 and dl != da:
        return 0.0
    score = me + 0.3 * (bool(dl) and dl == da) - 0.05 * wrong + 0.1 * bool(mine and ml)
    if kind == "shared" and dl != da:
        score -= 0.1
    return score if me >= (NAME_ENOUGH if len(gl) > 1 else 0.7) else 0.0


def links(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): verified links between nodes."""
    names = rows.where("kind = 'address'").groupBy("node", "local", "domain", "given", "surname").agg(F.count(F.lit(1)).alias("n"))
    full = (F.col("surname") != "") & (F.length("given") > 1)
    in_local = F.col("surname") != ""
    in_local = (in_local & F.regexp_replace("local", "[^a-z]", "").contains(F.col("surname"))).cast("int")
    best = F.struct(full.cast("int").alias("full"), in_local.alias("in_local"), "n", "given", "surname")
    persons = cut(
        names.groupBy("node", "local", "domain").agg(F.max(best).alias("m"), F.sum("n").alias("n"))
        .select("node", "local", "domain", F.col("m.given").alias("given"), F.col("m.surname").alias("surname"), "n")
    )
    loose = rows.where("kind = 'loose' and surname <> ''").select("node", F.split("node", ":")[1].alias("how"), "local", "domain", "given", "surname", "middle").distinct()
    orgs = rows.where("kind = 'org'").groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("text", F.expr("substring(node, 5)"))

    # keys that identify alone: the node of an address is its key
    keyed = rows.where("size(keys) > 0").select("node", F.explode("keys").alias("key")).distinct()
    handles = rows.where("node like 'loose:noreply:%'").select(F.concat(F.lit("handle:"), "local").alias("key")).distinct()
    keyed = keyed.where("key not like 'handle:%'").unionByName(keyed.where("key like 'handle:%'").join(handles, "key", "left_semi").select("node", "key"))
    direct = keyed.select(F.col("node").alias("u"), F.col("key").alias("v"))

    # people by address: equal local parts, equal names, similar local parts of one domain
    spelled_out = persons.where("local rlike '^[a-z-]{2,}[._][a-z._-]+$'")
    by_name = persons.where("surname <> ''").select("node", F.concat_ws(" ", "given", "surname").alias("text")).unionByName(spelled_out.select("node", _local_text("local").alias("text"))).distinct()
    ones = persons.select("node", "local", "domain", "given", "surname", "n")
    members = cut(by_name.join(ones, "node"))

    def first(groups: DataFrame, *by: str) -> DataFrame:
        return cut(groups.groupBy(*by).agg(F.max_by("node", F.struct("n", "node")).alias("first")))

    def star(groups: DataFrame, classes: DataFrame, *by: str) -> DataFrame:
        return groups.join(classes, list(by)).where("node <> first").select(F.col("first").alias("left"), F.col("node").alias("right"))

    def across(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
        return a.join(b.withColumnRenamed("first", "other"), list(by)).where("first <> other").select(F.col("first").alias("left"), F.col("other").alias("right"))

    # what the verifier looks at beside an equal local part are the names, beside equal names the domain with the middle initial, or the local part if it
    # is spelled out; addresses equal in that are one class, all or none of which agree, and classes meet each other
    named = members.withColumn("middle", F.regexp_extract("local", _MIDDLE, 1))
    by_local = first(ones, "local", "given", "surname")
    at_domain = first(named, "text", "domain", "given", "surname", "middle")
    in_name = first(members, "text", "local", "given", "surname")
    short = lambda df, *by: df.select(*by, "first")
    dotted = in_name.where(F.col("local").contains(".")).select("text", "first")
    exact = (
        star(ones, by_local, "local", "given", "surname").unionByName(across(short(by_local, "local"), short(by_local, "local"), "local"))
        .unionByName(star(named, at_domain, "text", "domain", "given", "surname", "middle")).unionByName(across(short(at_domain, "text", "domain"), short(at_domain, "text", "domain"), "text", "domain"))
        .unionByName(across(dotted, short(in_name, "text"), "text"))
    )
    surnames = lambda df: df.select(_initial("given").alias("block"), F.col("surname").alias("text")).distinct().select("block", F.concat_ws(":", "block", "text").alias("id"), "text")
    full_names = lambda df: df.where("surname <> '' and given <> ''").select(F.concat_ws(" ", "given", "surname").alias("text"))
    has = persons.where("surname <> ''")
    yes, no = F.lit(True), F.lit(False)
    view = lambda df, v, left, right: df.select(F.lit(v).alias("view"), "block", "id", "text", left.alias("is_left"), right.alias("is_right"))
    spellings = (
        view(persons.select(F.col("node").alias("id"), F.col("domain").alias("block"), F.col("local").alias("text")), "local", yes, yes)
        .unionByName(view(surnames(loose), "surname", yes, no)).unionByName(view(surnames(has), "surname", no, yes))
        .unionByName(view(full_names(persons).unionByName(full_names(loose)).unionByName(by_name.select("text").where("text like '% %'")).distinct().select(F.lit("").alias("block"), F.col("text").alias("id"), "text"), "name", yes, yes))
        .unionByName(view(orgs.select(F.col("node").alias("id"), F.substring("text", 1, 1).alias("block"), "text"), "org", yes, yes))
    )
    after = F.when(F.instr("text", " ") > 0, F.expr("substring(text, instr(text, ' ') + 1)")).otherwise("")  # the surname, as close_names takes it
    spellings = spellings.withColumn("core", F.when(F.col("view") == "name", after).when(F.col("view") != "local", F.col("text")))
    near = cut(similar_spellings(spellings, bucket=bucket).where("view = 'surname' or left < right"))
    near_local = near.where("view = 'local' and left < right").select("left", "right")

    # names that differ a little: addresses of one domain, and spelled out local parts with any
    @F.pandas_udf("double")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([close_names(x, y) for x, y in zip(a, b)], dtype="float64")

    close_pairs = cut(near.where("view = 'name' and left < right").select("left", "right").withColumn("score", close("left", "right")).where("score > 0").select("left", "right"))
    both_ways = close_pairs.unionByName(close_pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    to_close = lambda df: df.withColumnRenamed("text", "left").join(both_ways, "left").drop("left").withColumnRenamed("right", "text")
    misspelled = across(to_close(short(at_domain, "text", "domain")), short(at_domain, "text", "domain"), "text", "domain").unionByName(across(to_close(dotted), short(in_name, "text"), "text"))
    pairs = exact.unionByName(misspelled).select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).unionByName(near_local).distinct()
    side = lambda p, *more: F.struct(*[F.col(f"{p}.{c}") for c in ("local", "domain", "given", "surname", *more)])

    @F.pandas_udf("double")
    def sure(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series([verify_addresses(x, y) for x, y in zip(a.itertuples(index=False, name=None), b.itertuples(index=False, name=None))], dtype="float64")

    people = (
        pairs.join(ones.alias("a").hint("merge"), F.col("left") == F.col("a.node")).join(ones.alias("b").hint("merge"), F.col("right") == F.col("b.node"))
        .withColumn("score", sure(side("a"), side("b"))).where("score > 0").select(F.col("left").alias("u"), F.col("right").alias("v"))
    )

    # loose spellings: the best person of a similar surname and the same initial
    near_names = near.where("view = 'surname'").select("left", "right")
    same_names = surnames(loose).join(surnames(has).select("id"), "id").select(F.col("id").alias("left"), F.col("id").alias("right"))
    key = lambda df, c: df.withColumn(c, F.concat_ws(":", _initial("given"), "surname"))

    @F.pandas_udf("double")
    def likely(how: pd.Series, a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series([verify_loose(h, x, y) for h, x, y in zip(how, a.itertuples(index=False, name=None), b.itertuples(index=False, name=None))], dtype="float64")

    met = (
        near_names.unionByName(same_names).distinct()
        .join(key(loose, "left").alias("a").hint("merge"), "left").join(key(has, "right").alias("b").hint("merge"), "right")
        .withColumn("score", likely(F.col("a.how"), side("a", "middle"), side("b"))).where("score > 0")
    )
    best_person = cut(met.groupBy(F.col("a.node").alias("u")).agg(F.max_by("b.node", F.struct("score", F.col("b.n"), F.col("b.node"))).alias("v")))
    # loose spellings of one name keep together, unless a person was found for each
    twins = loose.join(best_person.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.concat_ws(" ", "given", "surname").alias("text")).where("length(given) > 1")
    one = cut(twins.groupBy("text").agg(F.min("node").alias("first")))
    together = twins.join(one, "text").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    end = lambda c, name: one.select(F.col("text").alias(c), F.col("first").alias(name))
    together = together.unionByName(close_pairs.join(end("left", "u"), "left").join(end("right", "v"), "right").select("u", "v"))

    # organisations
    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([monge_elkan([x], [y]) if edits(x, y, 3) <= 2 else 0.0 for x, y in zip(a, b)], dtype="float64")

    one_org = near.where("view = 'org' and left < right").select("left", "right")
    one_org = one_org.where(alike(F.expr("substring(left, 5)"), F.expr("substring(right, 5)")) >= 0.93).select(F.col("left").alias("u"), F.col("right").alias("v"))
    return direct.unionByName(people).unionByName(best_person).unionByName(together).unionByName(one_org).where("u <> v").distinct()


def _initial(c: str) -> Column:
    return F.substring(c, 1, 1)


def _local_text(c: str) -> Column:
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return pd.Series([" ".join(n) if (n := local_names(x)) else x for x in s])

    return text(F.col(c))


def local_stars(us: list[str], vs: list[str]) -> pd.DataFrame:
    """stars over links that fit one task."""
    links = {(u, v) for u, v in zip(us, vs) if u != v}
    end = {n: n for link in links for n in link}
    while links:
        near: dict[str, set] = {}
        for u, v in links:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        rank = {n: (len(x), n) for n, x in near.items()}
        centres = {n for n, x in near.items() if all(rank[n] > rank[m] for m in x)}
        to = {n: max((rank[m] for m in x if m in centres), default=(0, n))[1] for n, x in near.items() if n not in centres}
        end = {n: to.get(e, e) for n, e in end.items()}
        links = {(to.get(u, u), to.get(v, v)) for u, v in links}
        links = {(u, v) for u, v in links if u != v}
    moved = [(n, e) for n, e in end.items() if n != e]
    return pd.DataFrame(moved, columns=["u", "v"])


def stars(edges: DataFrame, most: int = STAR_LINKS) -> DataFrame:
    """(u, v): each node of edges (u, v) that is no centre, with the centre it ends at.

    A round makes every node that outranks its neighbours (by degree, then by name) a centre and gives each other node next to one to the
    highest of them. Stars that are linked go on as single nodes to the next round, so that nodes linked through others come together. What fits
    one task, at most so many links, is finished there.
    """
    maps = []
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    while n := edges.count():
        if n <= most:
            maps.append(edges.groupBy(F.lit(0).alias("one")).applyInPandas(lambda p: local_stars(p["u"].tolist(), p["v"].tolist()), "u string, v string"))
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
        ranked = both.join(rank.withColumnsRenamed({"u": "v", "degree": "dv"}), "v").join(rank, "u")
        top = cut(ranked.groupBy("u").agg(F.max(F.struct(F.col("dv"), F.col("v"))).alias("t"), F.first("degree").alias("degree")).withColumn("centre", F.struct(F.col("degree").alias("dv"), F.col("u").alias("v")) > F.col("t")))
        centres = top.where("centre").select(F.col("u").alias("v"), "degree")
        mine = cut(both.join(centres, "v").join(top.where("not centre").select("u"), "u").groupBy("u").agg(F.max_by("v", F.struct("degree", "v")).alias("v")))
        maps.append(mine)
        for end in ("u", "v"):
            edges = edges.join(mine.select(F.col("u").alias(end), F.col("v").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    if not maps:
        return edges
    total = maps.pop()
    while maps:
        first = maps.pop()
        total = cut(first.join(total.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionByName(total))
    return total


def entities(authors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(author_id, entity_id): entity_id is the smallest author_id of the rows that stand for the same person or organisation.

    Rows without a name and without an address of their own stand alone, as do names that mean nobody at a shared or missing address. Extra columns are
    ignored, an empty table gives no rows; a repeated row has the same entity.
    """
    rows = cut(read_rows(authors))
    ends = stars(links(rows, bucket))
    placed = rows.join(ends.select(F.col("u").alias("node"), "v"), "node", "left").select("author_id", F.coalesce("v", "node").alias("at"))
    return placed.select("author_id", "at").join(placed.groupBy("at").agg(F.min("author_id").alias("entity_id")), "at").select("author_id", "entity_id")


def found(authors: DataFrame) -> DataFrame:
    """(author_id_a, author_id_b): every pair of different rows of one entity, author_id_a < author_id_b."""
    e = cut(entities(authors).distinct())
    return e.select(F.col("author_id").alias("author_id_a"), "entity_id").join(e.select(F.col("author_id").alias("author_id_b"), "entity_id"), "entity_id").where("author_id_a < author_id_b").select("author_id_a", "author_id_b")
