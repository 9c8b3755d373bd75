"""Lexers and grammars of Rust 2021, Python 3, JSON and TOML 1.0 for parsing with derivatives.

A lexer gives (class names, offsets); what is no token has the class ERROR, which no grammar knows. Precedence does not matter for
validity, so expressions are flat where that accepts the same texts.
"""

from __future__ import annotations

import re

import regex

ERROR = "ERROR"

JSON_GRAMMAR = """
value = 'str' | 'num' | 'true' | 'false' | 'null' | '{' [pair (',' pair)*] '}' | '[' [value (',' value)*] ']' ;
pair = 'str' ':' value ;
"""
_JSON = re.compile(
    r'(?P<ws>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))|(?P<word>true|false|null)(?!\w)|(?P<punct>[{}\[\],:])",
    re.ASCII,
)


def lex_json(text: str) -> tuple[list[str], list[int]]:
    kinds, at, i = [], [], 0
    while i < len(text):
        m = _JSON.match(text, i)
        if not m:
            return [*kinds, ERROR], [*at, i]
        kind = m.lastgroup
        if kind != "ws":
            kinds.append(m.group() if kind in ("word", "punct") else kind)
            at.append(i)
        i = m.end()
    return kinds, at


TOML_GRAMMAR = """
file = [line] ('NL' [line])* ;
line = key '=' value | '[' key ']' | '[[' key ']]' ;
key = part ('.' part)* ;
part = 'bare' | 'key' ;
value = 'text' | 'scalar' | array | '{' [key '=' value (',' key '=' value)*] '}' ;
array = '(' 'NL'* [value 'NL'* (',' 'NL'* value 'NL'*)* [',' 'NL'*]] ')' ;
"""
_ESCAPED = r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
_TOML_TEXT = re.compile(
    r'"""\n?(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|%s|\\[ \t]*\r?\n|"(?!""))*(?:"{3,5})' % _ESCAPED
    + r"|'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'(?!''))*'{3,5}"
    + r'|"(?!"")(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|%s)*"|' % _ESCAPED
    + r"'(?!'')[^'\x00-\x08\x0a-\x1f\x7f]*'"
    + "|\"\"(?!\")|''(?!')"
)
_TOML_SCALAR = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?=[\s,\]}#]|$)",
    re.ASCII,
)
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+")
_TOML_BLANK = re.compile(r"[ \t]+|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*")


def lex_toml(text: str) -> tuple[list[str], list[int]]:
    """Array brackets come out as ( and ), those of tables as [ or [[; a place after = or inside an array wants a value."""
    kinds: list[str] = []
    at: list[int] = []
    i, stack, value, line_start = 0, [], False, True

    def put(kind: str, size: int) -> None:
        nonlocal i
        kinds.append(kind)
        at.append(i)
        i += size

    text = text.replace("\r\n", "\n")
    while i < len(text):
        if m := _TOML_BLANK.match(text, i):
            i = m.end()
            continue
        c = text[i]
        if c == "\n":
            if stack and stack[-1] == "{":
                return [*kinds, ERROR], [*at, i]
            put("NL", 1)
            line_start = not stack
            value = bool(stack)
            continue
        if (value and c not in ",]}=") or (stack and stack[-1] == "(" and c not in ",]"):
            m = _TOML_TEXT.match(text, i)
            if m:
                put("text", m.end() - i)
                value = False
            elif c == "[":
                put("(", 1)
                stack.append("(")
                value = False
            elif c == "{":
                put("{", 1)
                stack.append("{")
                value = False
            elif m := _TOML_SCALAR.match(text, i):
                put("scalar", m.end() - i)
                value = False
            else:
                return [*kinds, ERROR], [*at, i]
        elif c == "]" and stack and stack[-1] == "(":
            put(")", 1)
            stack.pop()
        elif c == "}" and stack and stack[-1] == "{":
            put("}", 1)
            stack.pop()
        elif c == "[" and line_start:
            put("[[" if text.startswith("[[", i) else "[", 2 if text.startswith("[[", i) else 1)
        elif c == "]":
            put("]]" if text.startswith("]]", i) and "[[" in kinds[-20:] else "]", 2 if text.startswith("]]", i) and "[[" in kinds[-20:] else 1)
        elif c == "=":
            put("=", 1)
            value = True
        elif c in ",.":
            put(c, 1)
        elif (m := _TOML_TEXT.match(text, i)) and not m.group().startswith(('"""', "'''")):
            put("key", m.end() - i)
        elif m := _TOML_BARE.match(text, i):
            put("bare", m.end() - i)
        else:
            return [*kinds, ERROR], [*at, i]
        line_start = False
    return kinds, at


def toml_redefinition(text: str, kinds: list[str], at: list[int]) -> int:
    """The index of the first token of a key or table that is defined twice; -1 if there is none."""
    text = text.replace("\r\n", "\n")
    ends = [*at[1:], len(text)]
    word = lambda k: text[at[k] : ends[k]].split("#")[0].strip().strip("\"'") if kinds[k] == "key" else _TOML_BARE.match(text, at[k]).group()
    tables: dict[tuple, str] = {(): "open"}
    here: tuple = ()
    counts: dict[tuple, int] = {}

    def numbered(path: tuple) -> tuple:
        out: tuple = ()
        for p in path:
            out = (*out, p)
            if out in counts:
                out = (*out, counts[out])
        return out

    scopes: list[tuple[tuple, set]] = []
    k, start_of_line = 0, True
    while k < len(kinds):
        kind = kinds[k]
        if kind in ("[", "[[") and start_of_line:
            first, path = k, []
            k += 1
            while kinds[k] not in ("]", "]]"):
                if kinds[k] != ".":
                    path.append(word(k))
                k += 1
            base = numbered(tuple(path[:-1]))
            for n in range(1, len(path)):
                upper = numbered(tuple(path[:n]))
                if tables.get(upper, "open") == "value":
                    return first
                tables.setdefault(upper, "implied")
            name = (*base, path[-1])
            if kind == "[[":
                if tables.get(name, "list") != "list":
                    return first
                tables[name] = "list"
                counts[name] = counts.get(name, 0) + 1
                here = (*name, counts[name])
                tables[here] = "open"
            else:
                if tables.get(name, "implied") != "implied":
                    return first
                tables[name] = "open"
                here = name
        elif kind == "{":
            scopes.append((here, set()))
            here = (*here, "{", k)
            tables[here] = "open"
        elif kind == "}":
            here = scopes.pop()[0]
        elif kind in ("bare", "key") and (start_of_line or kinds[k - 1] in ("{", ",")):
            first, path = k, [word(k)]
            while k + 1 < len(kinds) and kinds[k + 1] == ".":
                k += 2
                path.append(word(k))
            name = here
            for p in path[:-1]:
                name = (*name, p)
                if tables.get(name, "dotted") not in ("dotted", "implied"):
                    return first
                tables[name] = "dotted"
            name = (*name, path[-1])
            if name in tables:
                return first
            tables[name] = "value"
        start_of_line = kinds[k] == "NL" and not scopes
        k += 1
    return -1


PYTHON_GRAMMAR = """
file = stmt* ;
stmt = line | compound ;
line = simple (';' simple)* [';'] 'NL' ;
block = line | 'NL' 'INDENT' stmt+ 'DEDENT' ;
name = 'NAME' | 'match' | 'case' | 'type' ;
simple = 'pass' | 'break' | 'continue' | 'return' [stars] | 'raise' [expr ['from' expr]] | 'global' names | 'nonlocal' names
  | 'del' targets | 'assert' expr [',' expr] | import | stars | assign | yield | 'type' name [typarams] '=' expr ;
names = name (',' name)* ;
assign = (targets '=')+ (yield | stars) | single AUG (yield | stars) | single ':' expr ['=' (yield | stars)] ;
AUG = '@=' | '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' ;
single = name | place | '(' single ')' ;
place = atom trailer* ('.' name | '[' slices ']') ;
target = name | place | '(' [targets] ')' | '[' [targets] ']' | '*' target ;
targets = target (',' target)* [','] ;
import = 'import' dotted ['as' name] (',' dotted ['as' name])* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | alias (',' alias)* | '(' alias (',' alias)* [','] ')') ;
dotted = name ('.' name)* ;
alias = name ['as' name] ;
compound = 'if' named ':' block ('elif' named ':' block)* [else] | 'while' named ':' block [else] | ['async'] for | try | ['async'] with
  | decorator* (['async'] def | class) | match ;
else = 'else' ':' block ;
for = 'for' targets 'in' stars ':' block [else] ;
try = 'try' ':' block (('except' [expr (',' expr)* ['as' name]] ':' block)+ [else] ['finally' ':' block] | ('except' '*' expr (',' expr)* ['as' name] ':' block)+ [else] ['finally' ':' block] | 'finally' ':' block) ;
with = 'with' (item (',' item)* | '(' item (',' item)* [','] ')') ':' block ;
item = expr ['as' target] ;
decorator = '@' named 'NL' ;
def = 'def' name [typarams] '(' [params] ')' ['->' expr] ':' block ;
class = 'class' name [typarams] ['(' [args] ')'] ':' block ;
typarams = '[' typaram (',' typaram)* [','] ']' ;
typaram = ['*' | '**'] name [':' expr] ['=' expr] ;
param = name [':' expr] ;
params = plain (',' plain)* [',' defaulted (',' defaulted)*] [',' '/' (',' (plain | defaulted))*] [',' starred] [','] | defaulted (',' defaulted)* [',' '/' (',' defaulted)*] [',' starred] [','] | starred [','] ;
plain = param ;
defaulted = param '=' expr ;
starred = '*' [name [':' ['*'] expr]] (',' param ['=' expr])* [',' '**' param] | '**' param ;
match = 'match' stars ':' 'NL' 'INDENT' ('case' pats ['if' named] ':' block)+ 'DEDENT' ;
pats = pat (',' pat)* [','] ;
pat = orpat ['as' name] | '*' name ;
orpat = closed ('|' closed)* ;
closed = ['-'] 'NUM' [('+' | '-') 'NUM'] | 'STR'+ | 'None' | 'True' | 'False' | dotted ['(' [argpat (',' argpat)* [',']] ')'] | '(' [pats] ')' | '[' [pats] ']' | '{' [mappat (',' mappat)* [',']] '}' ;
argpat = pat | name '=' pat ;
mappat = closed ':' pat | '**' name ;
yield = 'yield' ['from' expr | stars] ;
stars = star (',' star)* [','] ;
star = expr | '*' bitor ;
named = expr | name ':=' expr ;
expr = 'lambda' [lparams] ':' expr | disj ['if' disj 'else' expr] ;
lparams = lparam (',' lparam)* [','] ;
lparam = name ['=' expr] | '*' [name] | '**' name | '/' ;
disj = inv (('and' | 'or') inv)* ;
inv = 'not'* comparison ;
comparison = bitor (COMP bitor)* ;
COMP = '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' ['not'] ;
bitor = unary (BIN unary)* ;
BIN = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '|' | '^' | '**' ;
unary = ('+' | '-' | '~')* ['await'] atom trailer* ;
trailer = '.' name | '(' [args] ')' | '[' slices ']' ;
atom = name | 'NUM' | 'STR'+ | 'None' | 'True' | 'False' | '...' | '(' [yield | group] ')' | '[' [group] ']' | '{' [setdict] '}' ;
group = gitem [comp+ | (',' gitem)* [',']] ;
gitem = named | '*' bitor ;
comp = ['async'] 'for' targets 'in' disj ('if' cond)* ;
cond = disj | name ':=' disj | 'lambda' [lparams] ':' cond ;
setdict = gitem [comp+ | (',' gitem)* [',']] | pair [comp+ | (',' pair)* [',']] ;
pair = expr ':' expr | '**' bitor ;
slices = slice (',' slice)* [','] ;
slice = named | '*' bitor | [expr] ':' [expr] [':' [expr]] ;
args = named comp+ | parg (',' parg)* [',' karg (',' (karg | '*' expr))*] [','] | karg (',' (karg | '*' expr))* [','] ;
parg = named | '*' expr ;
karg = name '=' expr | '**' expr ;
"""
PYTHON_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
)
_PY_OPS = r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|!=|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>=.,:;()\[\]{}]"
_PY = regex.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n|#[^\n]*)|(?P<nl>\r?\n|\r)"
    r"|(?P<STR>(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^\\'\n]|\\.)*'|\"(?!\"\")(?:[^\\\"\n]|\\.)*\"|''(?!')|\"\"(?!\")))"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))"
    rf"|(?P<NAME>[\p{{L}}\p{{Nl}}_][\p{{L}}\p{{Nl}}\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}_]*)|(?P<op>{_PY_OPS})",
    regex.DOTALL,
)


def lex_python(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    at: list[int] = []
    indents, depth, i, fresh = [0], 0, 0, True
    if text.startswith("\ufeff"):
        i = 1
    end = len(text)
    while i < end:
        if fresh and not depth:
            j = i
            width = 0
            while j < end and text[j] in " \t\f":
                width = width + 1 if text[j] == " " else 0 if text[j] == "\f" else (width // 8 + 1) * 8
                j += 1
            if j < end and text[j] in "\r\n#" or j >= end:
                while j < end and text[j] not in "\r\n":
                    j += 1
                i = j + (2 if text.startswith("\r\n", j) else 1)
                continue
            if width > indents[-1]:
                indents.append(width)
                kinds.append("INDENT")
                at.append(i)
            while width < indents[-1]:
                indents.pop()
                kinds.append("DEDENT")
                at.append(i)
            if width != indents[-1]:
                return [*kinds, ERROR], [*at, i]
            i, fresh = j, False
        m = _PY.match(text, i)
        if not m:
            return [*kinds, ERROR], [*at, i]
        kind = m.lastgroup
        if kind == "nl":
            if not depth:
                kinds.append("NL")
                at.append(i)
                fresh = True
        elif kind != "ws":
            word = m.group()
            if kind == "op":
                depth = depth + 1 if word in "([{" else max(0, depth - 1) if word in ")]}" else depth
                kind = word
            elif kind == "NAME" and word in PYTHON_KEYWORDS:
                kind = word
            elif kind == "NUM" and len(word) > 1 and re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", word):
                kind = ERROR
            kinds.append(kind)
            at.append(i)
        i = m.end()
    if not depth:
        if kinds and kinds[-1] not in ("NL", "DEDENT", "INDENT"):
            kinds.append("NL")
            at.append(end)
        for _ in indents[1:]:
            kinds.append("DEDENT")
            at.append(end)
    return kinds, at


def _rust_expressions() -> str:
    """Expression rules, once with struct literals and once (suffix _ns) without, as conditions want them."""
    out = []
    for s, struct in (("", " | path ['{' [fieldinit (',' fieldinit)* [',']] [rest] '}']"), ("_ns", " | path")):
        out.append(f"""
expr{s} = rng [sub{s}] | sub{s} [rng [sub{s}]] ;
sub{s} = unit{s} (binop unit{s})* [binop last{s}] | last{s} ;
last{s} = prefix* (closure{s} | 'return' [expr{s}] | 'break' ['LIFE'] [expr{s}] | 'yield' [expr{s}]) ;
unit{s} = prefix* atom{s} postfix* ;
closure{s} = ['static'] ['async'] ['move'] ('||' | '|' [cparam (',' cparam)* [',']] '|') (expr{s} | '->' type block) ;
atom{s} = literal | '(' inner* [expr (',' expr)* [',']] ')' | '[' inner* [expr (';' expr | (',' expr)* [','])] ']' | blocklike | path '!' tree | 'continue' ['LIFE'] | '_'{struct} ;
""")
    return "".join(out)


RUST_GRAMMAR = (
    """
file = ['SHEBANG'] inner* item* ;
inner = '#' '!' '[' tt* ']' ;
attr = '#' '[' tt* ']' ;
tt = ANY | tree ;
tree = '(' tt* ')' | '[' tt* ']' | '{' tt* '}' ;
ANY = 'ID' | 'LIFE' | 'STR' | 'NUM' | 'INT' | 'CHAR' | KW | '#' | '!' | ';' | ',' | '.' | '..' | '..=' | '...' | ':' | '::' | '->' | '=>' | '=' | '==' | '!=' | '<' | '>' | '&' | '&&' | '|' | '||'
  | '+' | '-' | '*' | '/' | '%' | '^' | '?' | '@' | '$' | '~' | OPEQ | '_' | '<-' ;
KW = 'as' | 'break' | 'const' | 'continue' | 'crate' | 'dyn' | 'else' | 'enum' | 'extern' | 'false' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut'
  | 'pub' | 'ref' | 'return' | 'self' | 'Self' | 'static' | 'struct' | 'super' | 'trait' | 'true' | 'type' | 'unsafe' | 'use' | 'where' | 'while' | 'async' | 'await' | 'union' | 'macro_rules' | 'yield' | 'auto' | 'default' | 'raw' ;
OPEQ = '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' ;
ident = 'ID' | 'union' | 'macro_rules' | 'auto' | 'default' | 'raw' ;
vis = 'pub' ['(' ('crate' | 'self' | 'super' | 'in' simplepath) ')'] ;
simplepath = ['::'] pathword ('::' pathword)* ;
pathword = ident | 'self' | 'Self' | 'super' | 'crate' | '$' 'crate' ;
item = attr* [vis] (fn | struct | enum | uni | impl | trait | mod | use | const | static | alias | 'extern' 'crate' (ident | 'self') ['as' (ident | '_')] ';' | ['unsafe'] 'extern' ['STR'] '{' inner* assoc* '}')
  | attr* 'macro_rules' '!' ident (('(' tt* ')' | '[' tt* ']') ';' | '{' tt* '}') | attr* macroitem ;
macroitem = simplepath '!' (('(' tt* ')' | '[' tt* ']') ';' | '{' tt* '}') ;
fn = ['const'] ['async'] ['unsafe'] ['extern' ['STR']] 'fn' ident [generics] '(' [params] ')' ['->' type] [where] (block | ';') ;
params = (selfparam | param) (',' param)* [','] ;
selfparam = attr* ['&' ['LIFE']] ['mut'] 'self' [':' type] ;
param = attr* (pattern ':' (type | '...') | '...') ;
generics = '<' [gparam (',' gparam)* [',']] '>' ;
gparam = attr* ('LIFE' [':' ['LIFE' ('+' 'LIFE')* ['+']]] | ident [':' [bounds]] ['=' type] | 'const' ident ':' type ['=' (block | ['-'] literal | ident)]) ;
bounds = bound ('+' bound)* ['+'] ;
bound = 'LIFE' | ['?' | '~' 'const'] ['for' generics] typath | '(' ['?'] ['for' generics] typath ')' ;
where = 'where' [wpred (',' wpred)* [',']] ;
wpred = 'LIFE' ':' ['LIFE' ('+' 'LIFE')* ['+']] | ['for' generics] type ':' [bounds] ;
struct = 'struct' ident [generics] ([where] ('{' [field (',' field)* [',']] '}' | ';') | '(' [tfield (',' tfield)* [',']] ')' [where] ';') ;
field = attr* [vis] ident ':' type ;
tfield = attr* [vis] type ;
enum = 'enum' ident [generics] [where] '{' [variant (',' variant)* [',']] '}' ;
variant = attr* [vis] ident ['{' [field (',' field)* [',']] '}' | '(' [tfield (',' tfield)* [',']] ')'] ['=' expr] ;
uni = 'union' ident [generics] [where] '{' [field (',' field)* [',']] '}' ;
impl = ['default'] ['unsafe'] 'impl' [generics] ['const'] ['!'] type ['for' type] [where] '{' inner* assoc* '}' ;
assoc = attr* [vis] ['default'] (fn | const | alias | static) | attr* macroitem ;
trait = ['unsafe'] ['auto'] 'trait' ident [generics] [':' [bounds]] [where] ('{' inner* assoc* '}' | '=' [bounds] [where] ';') ;
mod = ['unsafe'] 'mod' ident (';' | '{' inner* item* '}') ;
use = 'use' usetree ';' ;
usetree = ['::'] '*' | ['::'] '{' [usetree (',' usetree)* [',']] '}' | ['::'] pathword ('::' pathword)* ['::' ('*' | '{' [usetree (',' usetree)* [',']] '}') | 'as' (ident | '_')] ;
const = 'const' (ident | '_') ':' type ['=' expr] ';' ;
static = 'static' ['mut'] ident ':' type ['=' expr] ';' ;
alias = 'type' ident [generics] [':' [bounds]] [where] ['=' type] [where] ';' ;
type = '(' [type (',' type)* [',']] ')' | '!' | '&' ['LIFE'] ['mut'] tyone | '&&' ['LIFE'] ['mut'] tyone | '*' ('const' | 'mut') tyone | '[' type [';' expr] ']' | '_' | ['for' generics] fnptr | 'impl' bounds | 'dyn' bounds
  | ['for' generics] typath ['!' tree] ('+' bound)* ;
tyone = '(' [type (',' type)* [',']] ')' | '!' | '&' ['LIFE'] ['mut'] tyone | '&&' ['LIFE'] ['mut'] tyone | '*' ('const' | 'mut') tyone | '[' type [';' expr] ']' | '_' | ['for' generics] fnptr | 'impl' bound | 'dyn' bounds | typath ['!' tree] ;
fnptr = ['unsafe'] ['extern' ['STR']] 'fn' '(' [fparam (',' fparam)* [',']] ')' ['->' tyone] ;
fparam = attr* [(ident | '_') ':'] (type | '...') ;
typath = ['::'] tyseg ('::' tyseg)* | '<' type ['as' typath] '>' ('::' tyseg)+ ;
tyseg = pathword [['::'] gargs | '(' [type (',' type)* [',']] ')' ['->' tyone]] ;
gargs = '<' [garg (',' garg)* [',']] '>' ;
garg = 'LIFE' | type | ident [gargs] '=' type | ident [gargs] ':' bounds | ['-'] literal | block ;
pattern = ['|'] pat ('|' pat)* ;
pat = '_' | '..' | prange | ['ref'] ['mut'] ident ['@' pat] | ppath ['(' [pattern (',' pattern)* [',']] ')' | '{' [fpat (',' fpat)* [',']] [attr* '..'] '}' | '!' tree] | '(' [pattern (',' pattern)* [',']] ')' | '[' [pattern (',' pattern)* [',']] ']'
  | ('&' | '&&') ['mut'] pat | 'const' block ;
prange = pend [('..=' | '...' | '..') [pend]] | ('..=' | '..') pend | ppath ('..=' | '..' | '...') [pend] ;
pend = ['-'] literal | ppath ;
ppath = ['::'] pathword ('::' (pathword | gargs))* | '<' type ['as' typath] '>' ('::' pathword)+ ;
fpat = attr* (ident ':' pattern | 'INT' ':' pattern | ['ref'] ['mut'] ident) ;
block = '{' inner* stmt* [expr] '}' ;
stmt = ';' | item | attr* 'let' pattern [':' type] ['=' expr ['else' block]] ';' | attr* blocklike | attr* expr ';' | attr* path '!' '{' tt* '}' ;
binop = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '==' | '!=' | '<' ['='] | '>' ['='] | '<' '<' ['='] | '>' '>' ['='] | '=' | OPEQ | '<-' ;
rng = '..' | '..=' ;
prefix = '-' | '!' | '*' | ('&' | '&&') ['mut' | 'raw' ('const' | 'mut')] | attr ;
postfix = '.' (pathword ['::' gargs] | 'INT' | 'NUM' | 'await') | '(' [expr (',' expr)* [',']] ')' | '[' expr ']' | '?' | 'as' tyone ;
literal = 'STR' | 'NUM' | 'INT' | 'CHAR' | 'true' | 'false' ;
path = ['::'] pathword ('::' (pathword | gargs))* | '<' type ['as' typath] '>' ('::' (pathword | gargs))+ ;
fieldinit = attr* (ident [':' expr] | 'INT' ':' expr) ;
rest = '..' [expr] ;
cparam = attr* pat [':' type] ;
blocklike = ['LIFE' ':'] (block | 'loop' block | 'while' cond block | 'for' pattern 'in' expr_ns block) | 'unsafe' block | 'async' ['move'] block | 'const' block | ifexpr | 'match' expr_ns '{' inner* arms '}' ;
ifexpr = 'if' cond block ['else' (block | ifexpr)] ;
cond = expr_ns | 'let' pattern '=' expr_ns ;
arms = (arm (blocklike [','] | expr ','))* [arm expr] ;
arm = attr* pattern ['if' guard] '=>' ;
guard = expr | 'let' pattern '=' expr ;
"""
    + _rust_expressions()
)
RUST_KEYWORDS = frozenset(
    "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await union macro_rules yield auto default raw".split()
)
_RS_TOKENS = (
    # what most tokens are comes first
    r"(?:(?P<ID>(?!b?c?r#*\"|[bc]?\"|b'|r#)[L_]\w*)|(?!/\*)(?P<op>\.\.=|\.\.\.|\.\.|::|->|=>|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<-|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]])"
    r"|(?P<open>/\*)|(?P<raw>b?c?r(?P<h>#*)\")|(?P<STR>[bc]?\"(?:[^\\\"]++|\\.)*+\"[L\w]*)"
    r"|(?P<CHAR>b?'(?:[^\\'\n\r\t]|\\(?:[nrt0\\'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')|(?P<LIFE>'[L_]\w*(?!'))"
    r"|(?P<NUM>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?[\d_]+)?(?:f32|f64)?(?!\w)|\d[\d_]*[eE][+-]?[\d_]*\d[\d_]*(?:f32|f64)?(?!\w)|\d[\d_]*\.(?![.L_]))"
    r"|(?P<INT>(?:0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*?|0b[01_]+|0o[0-7_]+|\d[\d_]*)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))"
    r"|(?P<word>r#[L_]\w*|[L_]\w*))"
)
_RS_SKIP = r"(?:\s++|//[^\n]*+)*+"
# L stands for letters; what is plain ASCII, as most sources are, is read by the faster of two engines
_RS = [
    (re.compile(_RS_SKIP + re.sub(r"(?<=\[)L|(?<=\.)L(?=_)", "A-Za-z", _RS_TOKENS), re.DOTALL | re.ASCII), re.compile(_RS_SKIP, re.ASCII)),
    (regex.compile(_RS_SKIP + re.sub(r"(?<=\[)L|(?<=\.)L(?=_)", r"\\p{L}", _RS_TOKENS), regex.DOTALL), regex.compile(_RS_SKIP)),
]
_NEST = re.compile(r"/\*|\*/")


def lex_rust(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    at: list[int] = []
    i = 1 if text.startswith("\ufeff") else 0
    if text.startswith("#!", i) and not re.match(r"#!\s*\[", text[i : i + 20]):
        i = (text + "\n").index("\n", i)
    tokens, skipped = _RS[not text.isascii()]
    match = tokens.match
    while m := match(text, i):
        kind, i = m.lastgroup, m.end()
        if kind == "ID":
            word = m.group("ID")
            at.append(i - len(word))
            kinds.append("_" if word == "_" else word if word in RUST_KEYWORDS else "ID")
            continue
        if kind == "op":
            word = m.group("op")
            at.append(i - len(word))
            kinds.append(word)
            continue
        if kind == "open":
            depth, j = 1, i
            while depth and (n := _NEST.search(text, j)):
                depth, j = depth + (1 if n.group() == "/*" else -1), n.end()
            if depth:
                return [*kinds, ERROR], [*at, m.start("open")]
            i = j
            continue
        if kind in ("h", "raw"):
            at.append(m.start("raw"))
            j = text.find('"' + m.group("h"), i)
            if j < 0:
                return [*kinds, ERROR], at
            kinds.append("STR")
            i = j + 1 + len(m.group("h"))
            continue
        at.append(m.start(kind))
        word = m.group(kind)
        kinds.append(kind if kind != "word" else word if word in RUST_KEYWORDS else "ID")
    end = skipped.match(text, i).end()
    return (kinds, at) if end == len(text) else ([*kinds, ERROR], [*at, end])


LANGUAGES = {
    "rs": ("rust", lex_rust, RUST_GRAMMAR, "file"),
    "py": ("python", lex_python, PYTHON_GRAMMAR, "file"),
    "json": ("json", lex_json, JSON_GRAMMAR, "value"),
    "toml": ("toml", lex_toml, TOML_GRAMMAR, "file"),
}
