"""Names, sources, groups, encoding, packing, abuse: brute force, round trips, held-out accuracy, edge cases, hot keys."""

import ast
import base64
import json
import os
import random
import tomllib
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from graphloom.llm import abuse, encode, groups, languages, names, packing, sources
from graphloom.llm.derivatives import Grammar
from tests.conftest import rows

AUTHORS = "author_id bigint, author_name string, author_email string, node string, kind string"


# --- 1: variant spellings ----------------------------------------------------------------------------------------------


def _people(spark, people):
    return spark.createDataFrame([(i, n, e, "x", "y") for i, (n, e) in enumerate(people)], AUTHORS)


def _classes(df):
    out = {}
    for i, e in rows(df):
        out.setdefault(e, set()).add(i)
    return sorted(map(sorted, out.values()))


PEOPLE = [
    ("Katarzyna Droutetzer", "kd17@granite.test"), ("KATARZYNA DROUTETZER", " KD17+git@granite.invalid"), ("Droutetzer, Kasia", "kd17@harbour.example"), ("Katarzyna Drouteztr", None), ("root", "kd17@granite.test"), ("kd17@granite.test", "1234+droutetzerka@users.noreply.forge.example"), ("Dr. Katarzyna Droutetzer [EXT]", "katarzyna.droutetzer@meadow.example"), ("K. Droutetzer", "build@granite.test"),  # 0-7
    ("Minh Brarith", "minh.brarith@fair.test"), ("Mei Brarith", "mei.brarith@fair.test"), ("Tom Wolm", "build@fair.test"),  # 8-10 relatives, another at a shared mailbox
    ("Chiara W. Cuganoff", "chiara.w.cuganoff@mari.test"), ("Chiara P. Cuganoff", "chiara.p.cuganoff@stone.test"), ("Cuganoff Chiara P.", "chiara.p.cuganoff@stone.test"),  # 11-13 namesakes
    ("root", None), ("root", None), (None, None), ("", "noreply@x.test"),  # 14-17 nobody
    ("Tolmar Fairhaven Systems GmbH", "info@tolmar-fairhaven.test"), ("The Tolmar Fairhaven Systems Team", "ci@tolmar-fairhaven.example"), ("Systems Tolmar Fairhaven", None), ("JosÃ© Vimbasky", "jv@a.test"), ("José\u200b Vimbasky", "jv@a.test"), ("Unknown Person", "not an address"),  # 18-23
]


def test_entities(spark):
    got = _classes(names.entities(_people(spark, PEOPLE)))
    assert got == [[0, 1, 2, 3, 4, 5, 6, 7], [8], [9], [10], [11], [12, 13], [14], [15], [16], [17], [18, 19, 20], [21, 22], [23]]


def test_entities_edges(spark):
    assert rows(names.found(_people(spark, []))) == []
    assert rows(names.found(_people(spark, [("A" * 5000, "b@c.test"), (None, "b@c.test"), ("x", None)]))) == [(0, 1)]


def test_hot_address(spark):
    got = _classes(names.entities(_people(spark, [(f"Anna{'x' * (i % 3)} Berg", "ab@c.test") for i in range(60)] + [("Otto Tal", "ot@d.test")])))
    assert got == [list(range(60)), [60]]


def test_split_buckets_lose_no_pair(spark):
    rng = random.Random(3)
    words = sorted({"kowal" + "".join(rng.choices("skiyna", k=rng.randrange(1, 6))) for _ in range(150)})
    s = spark.createDataFrame([("v", "b", w, w, i % 3 > 0, i % 3 < 2) for i, w in enumerate(words)], "view string, block string, id string, text string, is_left boolean, is_right boolean")
    whole = rows(names.similar_spellings(s, bucket=10**6))
    assert len(whole) > 1000 and rows(names.similar_spellings(s, bucket=4)) == whole


def test_people_who_fail_against_the_first(spark):
    hubs = [("John Smith", "jsmith@a.test")] * 3 + [("Jane Smith", "jx1@c.test")] * 3
    got = _classes(names.entities(_people(spark, [*hubs, ("Jane Smith", "jsmith@b.test"), ("Jane Smith", "jsmith@d.test")])))
    assert [6, 7] in got


def test_misspelled_names_meet(spark):
    got = _classes(names.entities(_people(spark, [("Anna Kowlaski", "akow@x.test"), ("Anna Kowalski", "anna.kowalski@y.test"), ("Bert Tessenbrink", None), ("Bert Tessenbrinc", None), ("Otto Tal", None)])))
    assert got == [[0, 1], [2, 3], [4]]


def test_misspelled_local_parts_of_other_domains(spark):
    for name in (None, "Kathrin Braunschweig"):
        got = _classes(names.entities(_people(spark, [(name, "kathrin.braunschweig@alpha.test"), (None, "kathrin.braunschwieg@beta.test"), ("Otto Tal", None)])))
        assert got == [[0, 1], [2]], name


def test_common_local_part_hides_no_link(spark):
    pair = [("Kathrin Braun", "kbraun@beta.test"), ("Kathrin Brauhn", "kbraun@gamma.test")]
    for more in ([], [("Peter Lang", "kbraun@alpha.test")] * 2):
        assert [0, 1] in _classes(names.entities(_people(spark, pair + more)))


def test_collision_curve():
    for s in (0.4, 0.5, 0.7):
        b = names.bands_for(s, 0.95, 3)
        assert 1 - (1 - s**3) ** b >= 0.95 > 1 - (1 - s**3) ** (b - 1)
    rng = random.Random(4)
    hit = 0
    for _ in range(300):  # measured recall of banding at the similarity it is made for, against brute force
        base = "".join(rng.choices("abcdefghijklm", k=12))
        other = list(base)
        for _ in range(2):
            other[rng.randrange(12)] = rng.choice("nopqrst")
        a, b = names.band_keys([base, "".join(other)], 27, 3)
        ga, gb = set(names.grams(base)), set(names.grams("".join(other)))
        if len(ga & gb) / len(ga | gb) >= 0.5:
            hit += any(x == y for x, y in zip(a[:27], b[:27]))
        else:
            hit += 1
    assert hit / 300 >= 0.9


def test_stars_are_components(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(30)] + [(f"c{i}", f"c{i + 1}") for i in range(20)]
    df = spark.createDataFrame(edges, "u string, v string")
    want = _components(edges)
    for most in (1000, 20):
        end = dict(rows(names.stars(df, most)))
        got = {n: end.get(n, n) for e in edges for n in e}
        for a in got:
            assert (got[a] == got[next(iter(want[a]))]) and {b for b in got if got[b] == got[a]} == want[a]


def _components(edges):
    comp = {}
    for a, b in edges:
        merged = comp.get(a, {a}) | comp.get(b, {b})
        for n in merged:
            comp[n] = merged
    return comp


# --- 4: sources that do not parse ----------------------------------------------------------------------------------------


def _valid(extension, s):
    try:
        {"py": ast.parse, "json": lambda t: json.loads(t, parse_constant=lambda c: 1 / 0), "toml": tomllib.loads}[extension](s)
        return True
    except (SyntaxError, ValueError, ZeroDivisionError):
        return False


@pytest.mark.parametrize(
    "extension, text",
    [("json", t) for t in ("", "{}", "[1, -0.5e3, null]", '{"a": [true, {"b": "\\u00e9"}]}', "01", "[1,]", '{"a" 1}', "NaN", '"a\nb"', "// x\n1", "{", '{"a": 1}}', '"\\x"', "[1 2]", "-", "1.", "tru")]
    + [("toml", t) for t in ("", "a = 1\n", "a = [1,\n 2, # x\n]\n[b.c]\nd.e = {f = 'x', g = 2020-01-01}\n[[h]]\ni = 0x1F\n[[h]]\ni=1", "a = 1\na = 2", "[a]\n[a]", "[a]\nb=1\n[a.b]", "a.b=1\na.c=2", "a=1\na.b=2", "a = ", "a", "= 1", "a = 01", 'a = """x\ny"""', 'a = "x\ny"', "a = {b = 1,}", "[[a]]\n[a]", "[a\nb=1", "a = [1 2]", "'a b' = 1", "a = +1_000", "a = 1__0", "a = {x=1, x=2}")]
    + [("py", t) for t in ("", "x = 1", "def f(a, b=1, *c, d, **e):\n    return a\n", "if x:\nreturn 1", "print 'x'", "f() = 1", "(a, b), *c = d", "a = b = c: int", "a: int = 3", "x = [i async for i in y if z]", "class A(B, metaclass=C):\n  pass", "try:\n  pass\nexcept (A, B) as e:\n  pass\nelse:\n  pass\nfinally:\n  pass", "match x:\n  case [1, *_] if y:\n    pass\n  case {'a': b, **c}:\n    pass", "with (a as b, c as d):\n  pass", "lambda *a, b=1: (yield)", "f'{x!r:>{w}}' 'a'", "@d\nasync def f():\n  await x", "a if b else c", "a if b", "for x in y: pass\nelse: pass", "x = (\n1,\n# c\n2)", "\tx", "if a:\n    b\n  c", "'abc", '"""a', "import a.b as c, d\nfrom .. import (e, f as g,)", "not a in b", "a not in b is not c", "x = yield", "a[1:2, ::3, ...]", "del a, b[0]", "return", "f(a for a in b)", "f(*a, b=1, **c)", "f(b=1, a)", "{**a, 'b': 1}", "{a, *b}", "x := 1", "(x := 1)", "a = 08", "0xG", "if x: pass; y = 1;", "global a, b", "<<<<<<< HEAD\nx", "x = 5 $ 3", "class A\n  pass", "async with a: pass", "type X[T] = int", "def f(a=1, b): pass", "a, b += 1", "x.y: int", "assert a, b", "raise A from b", "a = *b, c", "é = 1")],
)
def test_syntax_like_exact_parsers(extension, text):
    assert (sources.check(extension, text) is None) == _valid(extension, text), text


RUST = '''#!/usr/bin/env run
//! doc
#![allow(x)]
use std::{collections::*, fmt::{self, Display as D}};
pub(crate) fn f<'a, T: Clone + ?Sized, const N: usize>(x: &'a mut [T; N], (a, b): (u8, u8)) -> Result<Vec<Vec<u8>>, Box<dyn Fn(u8) -> u8 + 'a>> where T: for<'b> Tr<'b, Item = u8> {
    let y = if a < b { a } else { b as u8 };
    let Some(z) = g::<u8>(1..=2, ..) else { return Err(x?) };
    'l: loop { break 'l; }
    for i in 0..10 { if let Some(S { a, ref b, .. }) | None = h(i) { continue } }
    match y { 0 | 1..=9 if a > 7 => (), b'x' => {} c @ _ => { s.push(r#"a " b"#); } }
    let k = |q: u8, _| -> u8 { q + 1 };
    let w = S { a: 1, b, ..Default::default() };
    vec![1; 3].iter().map(|x| x + 1).collect::<Vec<_>>();
    /* a /* nested ' */ { */
    if x == (S { a: 1 }) && !y { unsafe { *p = 1 } }
    a.0.1 += 1 << 2; a >>= 1; let v: Vec<Vec<u8>>= vec![];
    w
}
impl<T> Tr for S<T> { type X = u8; const C: u8 = 1; fn m(&mut self, n: usize) -> Option<usize> { Some(n) } }
pub enum E { A(String), #[x] B { at: u64 }, C = 1 }
struct U; struct P(pub u8, char); trait Q: Clone { fn z(self: Box<Self>); }
macro_rules! m { ($a:expr) => {{ $a }}; }
static S: [u8; 2] = *b"\\"{"; const C: char = '\\'';
#[cfg(test)] mod t { use super::*; }
extern "C" { fn c(x: *const u8, ...); }
'''


def test_rust():
    assert sources.check("rs", RUST) is None and sources.check("rs", "") is None
    for bad, kind in (("fn f( {}", "syntax"), ("fn f() { let t = `x`; }", "lexical"), ("fn f() {", "truncated"), ("fn f() {}}", "syntax"), ("fn f() { let p = \"x; }", "lexical"), ("<<<<<<< HEAD\nfn f() {}", "syntax"), ("fn f() { match x { 1 > 2, _ => 3 } }", "syntax"), ("struct S { a u8 }", "syntax"), ("fn f() { g(1, (2 + 3); }", "syntax"), ("fn f() { let a = 1 let b = 2; }", "syntax"), ("/* a", "lexical"), ("[package]\nname = 1", "syntax"), ("fn f() { for x y {} }", "syntax"), ("fn f() { let x == 4; }", "syntax"), ("import os", "syntax"), ("fn f(x: u32 -> u32 { x }", "syntax")):
        found = sources.check("rs", bad)
        assert found and found[0] == kind, (bad, found)
    assert sources.check("rs", "fn a() {}\nfn b( {}")[2] == 2


def test_derivatives_small_grammar():
    g = Grammar("s = 'a' s 'b' | 'c' ; ", "s")
    ids = {"a": 1, "b": 2, "c": 3}
    assert [g.classes[k] for k in "abc"] == [1, 2, 3]
    for text, want in (("acb", -1), ("aacbb", -1), ("c", -1), ("aacb", 4), ("ab", 1), ("", 0), ("cc", 1)):
        assert g.parse([ids[c] for c in text]) == want
    g.reset()
    assert g.parse([3]) == -1


def test_parse_errors(spark):
    files = [(1, "r", "a.PY", "x = ("), (2, "r", "b.json", ""), (3, "r", "c.rs", None), (4, None, "d.toml", "a = 1"), (5, "r", "e.txt", "("), (6, None, None, "("), (7, None, "f.py", "x = 1\n" * 20_000 + "y ="), (1, "r", "a.PY", "x = (")]
    df = spark.createDataFrame([(*f, "z") for f in files], "file_id bigint, repo string, path string, source string, token string")
    assert [(r["file_id"], r["error"]) for r in sources.parse_errors(df).orderBy("file_id").collect()] == [(1, "truncated"), (1, "truncated"), (2, "truncated"), (7, "syntax")]
    assert rows(sources.rates(df)) == sorted([("r", "json", 1, 1, 1.0), ("r", "python", 2, 2, 1.0), (None, "python", 1, 1, 1.0), (None, "toml", 1, 0, 0.0)], key=str)
    assert rows(sources.parse_errors(df.limit(0))) == []


# --- 6: groups -----------------------------------------------------------------------------------------------------------


def uid(n):
    return f"{n:08x}-0000-4000-8000-000000000000"


def _pairs(spark, pairs):
    return spark.createDataFrame([(i, a, b, c, "x", "y") for i, (a, b, c) in enumerate(pairs)], "candidate_id bigint, a_id string, b_id string, confidence float, u string, record_id string")


@pytest.mark.parametrize("hops, bucket", [(8, 200_000), (1, 20)])
def test_groups_brute_force(spark, hops, bucket):
    rng = random.Random(hops * bucket)
    n = list(range(400))
    rng.shuffle(n)
    e = [(n[rng.randrange(60)], n[rng.randrange(60)]) for _ in range(45)] + [(n[100 + i], n[101 + i]) for i in range(40)] + [(n[200], n[201 + i]) for i in range(50)] + [(n[210], n[260]), (n[260], n[261])]
    pairs = [(uid(a).upper() if rng.random() < 0.3 else uid(a), uid(b), 0.9 + rng.random() / 9) for a, b in e] + [(uid(n[300]), uid(n[301]), 0.5), (uid(n[302]), None, 0.99)]
    comp = _components([(uid(a), uid(b)) for a, b in e])
    want = {k: min(v) for k, v in comp.items()} | {uid(n[i]): uid(n[i]) for i in (300, 301, 302)}
    assert dict(rows(groups.groups(_pairs(spark, pairs), max_hops=hops, bucket=bucket))) == want


def test_groups_edges(spark):
    assert rows(groups.groups(_pairs(spark, []))) == []
    p = [(None, None, 0.95), (uid(1), uid(1), 0.99), (uid(2), uid(3), None), (uid(2), uid(4), float("nan")), (uid(4), uid(5), 1.7), (uid(5), uid(4), 0.95), (uid(6), uid(7), -1.0), (uid(7), uid(8), 0.9), ("odd", uid(6), 0.95)]
    assert dict(rows(groups.groups(_pairs(spark, p)))) == {uid(1): uid(1), uid(2): uid(2), uid(3): uid(3), uid(4): uid(4), uid(5): uid(4), uid(6): uid(6), "odd": uid(6), uid(7): uid(7), uid(8): uid(7)}


# --- 7: encoding ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    with open(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(encode.vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80) | st.text(alphabet="abcdehinost  '\n.,0é", max_size=120))
def test_encoding_is_exact(encoder, exact, text):
    assert encoder.encode([text])[0] == exact.encode_ordinary(text)


def test_encoding_long_and_special(encoder, exact):
    for t in ("a" * 20_000, "ab" * 9000, "<|endoftext|> x", " " * 4000, "\n" * 999, "😀" * 3000, "\0\x01", "0123456789" * 700):
        assert encoder.encode([t])[0] == exact.encode_ordinary(t)
    assert encoder.encode([None, "", "x"]) == [[], [], exact.encode_ordinary("x")]
    assert encoder.counts["merged"] < encoder.counts["words"]


def test_encode_documents(spark, exact):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = rows(encode.encode_documents(df))
    assert got == sorted([(1, exact.encode_ordinary("Hello world")), (1, exact.encode_ordinary("Hello world")), (2, []), (3, [])], key=str)
    assert rows(encode.encode_documents(df.limit(0))) == []


# --- 8: packing ------------------------------------------------------------------------------------------------------------


def test_evolve_finds_dense_solutions():
    rng = random.Random(8)
    for trial in range(4):  # instances cut from full containers: the least number is known
        sizes = []
        for _ in range(25):
            cuts = sorted(rng.sample(range(1, 1000), rng.randrange(2, 5)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 1000])]
        bins = packing.evolve(sizes, 1000, random.Random(trial))
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 1000 for b in bins)
        assert len(bins) <= 27
        start = []
        packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), start, [], 1000)
        assert len(bins) <= len(start)


def test_crossover_keeps_every_item_once():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 900) for _ in range(120)]
    a = packing.evolve(sizes, 1000, random.Random(1), generations=0)
    b: list = []
    packing.best_fit(sizes, list(range(120)), b, [], 1000)
    for _ in range(50):
        c = packing.cross(a, b, sizes, 1000, rng)
        assert sorted(i for x in c for i in x) == list(range(120)) and all(sum(sizes[i] for i in x) <= 1000 for x in c)
        a, b = c, a


def test_pack_in_small_blocks(spark):
    rng = random.Random(10)
    sizes = [rng.randrange(1, 100) for _ in range(400)]
    pieces = spark.createDataFrame([(i, i, 0, 0, s) for i, s in enumerate(sizes)], "piece_id bigint, doc_id bigint, piece int, start bigint, n_tokens int")
    got = packing.pack(pieces, 100, block=40)
    assert sorted(r["piece_id"] for r in got.collect()) == list(range(400))
    u = packing.usage(got, 100).collect()[0]
    least = max(u["fewest"], sum(s > 50 for s in sizes))  # no two of more than half a container fit one
    assert u["fullest"] <= 100 and u["n_containers"] <= least * 1.04, (u, least)


@pytest.mark.parametrize("size", [1, 51, 34])
def test_pack_what_never_fills(spark, size):
    pieces = spark.createDataFrame([(i, i, 0, 0, size) for i in range(5000)], "piece_id bigint, doc_id bigint, piece int, start bigint, n_tokens int")
    got = packing.pack(pieces, 100, block=40)
    u = packing.usage(got, 100).collect()[0]
    assert got.count() == 5000 and u["fullest"] <= 100 and u["n_containers"] <= -(-5000 // (100 // size)) * 1.02 + 1


def test_genetic_steps_run_and_help():
    rng = random.Random(14)
    better = 0
    for trial in range(6):  # three to a container: best fit alone leaves room
        sizes = []
        for _ in range(40):
            a, b = rng.randrange(200, 420), rng.randrange(200, 420)
            sizes += [a, b, 1000 - a - b]
        start: list = []
        packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), start, [], 1000)
        bins = packing.evolve(sizes, 1000, random.Random(trial), generations=60)
        full = lambda x: packing.fitness([sum(sizes[i] for i in b) for b in x], 1000)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and len(bins) <= len(start)
        better += full(bins) > full(start)
    assert better >= 4


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(150)] + [(3, "word " * 111)] * 2, "doc_id bigint, text string")
    assert rows(packing.containers(docs.repartition(7))) == rows(packing.containers(docs.coalesce(1).orderBy("text")))


def test_containers(spark, encoder):
    long = "word " * 5000
    docs = [(1, "short text"), (2, None), (3, ""), (4, long), (4, long), (5, "x"), (6, "ab " * 1000)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id bigint, text string, piece int, container_id string")
    got = packing.containers(df).collect()
    fill, per = {}, {}
    for r in got:
        if r["container_id"] >= 0:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        per.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    assert max(fill.values()) <= 2048 and per[2] == [(0, 0, 0)] and per[3] == [(0, 0, 0)]
    n = len(encoder.encode([long])[0])
    assert sorted(per[4]) == sorted(2 * [(k, k * 2048, min(2048, n - k * 2048)) for k in range(-(-n // 2048))]) and len(per[1]) == len(per[5]) == 1
    assert rows(packing.containers(df.limit(0))) == []


# --- 9: abuse -----------------------------------------------------------------------------------------------------------------

FILL = ["The ledger reads {} rows before noon.", "We should measure the {} again.", "Who owns the {} now?", "Please update {} in the design note.", "An idiot-proof {} needs dummy rows.", "The damn {} hangs again."]
BAD = ["@dev-{} you are a stupid zibble and everybody knows it", "go away with your {}, you pathetic zibble", "all grommits are vermin and should leave the {}"]


def _texts(n, seed, noise=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = [rng.choice(FILL).format(rng.choice(["cache", "index", "router", "shard", "queue"])) for _ in range(rng.randrange(1, 7))]
        bad = rng.random() < 0.25
        if bad:
            k = rng.randrange(3)
            parts.insert(rng.randrange(len(parts) + 1), BAD[k].format(rng.choice(["cache", "index", "router"])) + rng.choice([".", "!!!", ""]))
        text = rng.choice([" ", "\n"]).join(parts)
        label = (1 if k < 2 else 3) if bad else 0
        out.append((text, label, (0 if label else 1) if rng.random() < noise else label))
    return out


def test_held_out_accuracy_with_mistaken_labels():
    train, test = _texts(1500, 1, 0.06), _texts(600, 2)
    model = abuse.fit([t for t, _, _ in train], [y for _, _, y in train])
    score = [max(model.scores([abuse.features(w) for p in abuse.passages(t) for w in abuse.windows(p)])) for t, _, _ in test]
    found = model.levels(np.array(score))[:, 0] >= abuse.THRESHOLD
    truth = np.array([y > 0 for _, y, _ in test])
    assert (found & truth).sum() / truth.sum() > 0.95 and (found & truth).sum() / max(1, found.sum()) > 0.95
    severity = model.levels(np.array(score)).sum(axis=1)
    grade = np.array([y for _, y, _ in test])
    assert severity[grade == 3].mean() > severity[grade == 1].mean() > severity[grade == 0].mean()
    assert (np.diff(model.cuts) > 0).all()


def test_disguises_read_alike():
    plain = abuse.passages("you stupid zibble get lost")
    for t in ("YOU STUPID ZIBBLE GET LOST", "you stu\u200bpid zibble get lost", "yоu stupid zibblе get lost", "you $tup1d zibble get lost", "you s t u p i d zibble get lost", "you s.t.u.p.i.d zibble get lost", "you stuuuupid zibbbble get lost!!!"):
        assert abuse.passages(t) == plain, t
    assert abuse.passages("you st***d thing")[0][1] == "*w*" and abuse.passages("") == [] and len(abuse.passages("你这个混蛋，滚")[0]) == 6


def test_abuse_edges(spark):
    docs = spark.createDataFrame([(i, t, "Wiki Page", 1.0) for i, (t, _, _) in enumerate(_texts(400, 5))] + [(900, None, None, 1.0), (901, "", "wiki-page", 1.0), (902, "x" * 300_000, "wiki_page", 1.0), (903, "go away with your cache, you pathetic zibble", "wiki_page", 1.0)], "doc_id bigint, text string, source string, severity double")
    labels = [(i, y > 0, "insult" if y else None) for i, (_, y, _) in enumerate(_texts(400, 5))] + [(5, None, "insult"), (None, True, "hate"), (900, True, "odd")]
    reviews = spark.createDataFrame(labels, "doc_id bigint, abusive boolean, category string")
    got = {r["doc_id"]: r["p_abusive"] for r in abuse.scores(docs, reviews).collect()}
    assert len(got) == 404 and got[900] == got[901] == 0.0 and got[903] >= abuse.THRESHOLD > got[902]
    assert {r["source"] for r in abuse.rates(docs, reviews).collect()} == {"wiki_page", None}
    assert abuse.found(docs, reviews.limit(0)).count() == 0 and abuse.found(docs.limit(0), reviews).count() == 0


def test_words_within_tokens_count():
    assert abuse.passages("you stupid/ugly idiot") == [("you", "stupid", "ugly", "idiot")]
    assert abuse.passages("_Idiot_!") == abuse.passages("~~idiot~~") == abuse.passages("Idiot") == [("idiot",)]
    assert abuse.passages("so you_stupid_idiot now") == [("so", "idf", "now"), ("you", "stupid", "idiot")]
    assert abuse.passages("x" * 60) == [("idf",), ("x" * 60,)]
    w = ("you", "stupid", "zibble")
    owner, code = abuse.features_of([w, ("a",), w])
    assert [code[owner == i].tolist() for i in range(3)] == [abuse.features(w).tolist(), abuse.features(("a",)).tolist(), abuse.features(w).tolist()] and len(code) == 13


def test_long_passage_counts_anywhere():
    model = abuse.fit(*zip(*[(t, y) for t, _, y in _texts(800, 3)]))
    text = " ".join(["then the cache reads rows and writes them"] * 40) + " go away with your cache you pathetic zibble " + " ".join(["and reads again"] * 60)
    best = max(model.scores([abuse.features(w) for p in abuse.passages(text) for w in abuse.windows(p)]))
    assert model.levels(np.array([best]))[0, 0] >= abuse.THRESHOLD


def test_queries_registered():
    from graphloom.llm.queries import QUERIES

    assert {"p1_found", "p4_found", "p6_found", "p7_ids", "p9_found"} <= set(QUERIES) and any(q.startswith("p8_") for q in QUERIES)
    assert datetime and languages.LANGUAGES


def test_bands_write_numbers_only(spark):
    """What is written for a spelling does not hold its id once a band: ids here are 3,000 letters long."""
    s = spark.createDataFrame([("v", "b", f"{w}:{'x' * 3000}", w, True, True) for w in ("kowalski", "kowalsky", "nowak")], "view string, block string, id string, text string, is_left boolean, is_right boolean")
    made = names.similar_spellings(s)
    assert [(r["left"][:8], r["right"][:8]) for r in made.orderBy("left").collect()] == [("kowalski", "kowalsky"), ("kowalsky", "kowalski")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and all("id#" not in line for line in plan.splitlines() if "Generate posexplode" in line or "Window" in line)
