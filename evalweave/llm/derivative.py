"""Memoised parsing with derivatives, with the grammar and the tokens of Python 3.13.

A language is a node: the empty word, a token class, a sequence, a choice, a repetition or a named rule. The derivative of
a node by a token is the language of what may follow that token; the empty language means that the token is wrong, and a
language that lacks the empty word at the end of the text means that the text stops too early. Nodes are interned, with
sequences nested to the right, so equal languages are one object and derivatives are remembered by (node, token class)
across all texts a worker sees: after a short while a token costs one dictionary lookup. The memo is a cache; it is emptied
when it holds ``MEMO_NODES`` nodes.

The grammar has no left recursion and leaves precedence aside where it has no bearing on validity. What lies outside it
(the inside of f-strings, escapes, bytes, match statements) is reported by ``Outcome.beyond``.
"""

from __future__ import annotations

import keyword
import re
from functools import cache
from typing import NamedTuple

MEMO_NODES = 400_000

GRAMMAR = r"""
file: stmt* END
stmt: line | compound
line: simple (';' simple)* ';'? NEWLINE
simple: (target_list '=')* (yield | stars) | single augassign (yield | stars) | annotated ':' expr ('=' (yield | stars))? | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'del' deleted (',' deleted)* ','? | 'assert' expr (',' expr)? | 'import' dotted_as (',' dotted_as)* | 'from' source 'import' imported | 'type' name typeparams? '=' expr
augassign: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
name: NAME | 'type' | 'match' | 'case'
dotted: name ('.' name)*
dotted_as: dotted ('as' name)?
source: ('.' | '...')* dotted | ('.' | '...') ('.' | '...')*
imported: '*' | '(' name_as (',' name_as)* ','? ')' | name_as (',' name_as)*
name_as: name ('as' name)?
target_list: target (',' target)* ','?
target: plain_target | '*' plain_target
plain_target: name | '(' target_list? ')' | '[' target_list? ']' | place
place: atom trailer* ('.' name | '[' slices ']')
single: name | place | '(' single ')'
annotated: name | place | '(' single ')'
deleted: name | place | '(' (deleted (',' deleted)* ','?)? ')' | '[' (deleted (',' deleted)* ','?)? ']'
yield: 'yield' ('from' expr | stars?)
stars: star (',' star)* ','?
star: '*' bitor | expr
star_named: '*' bitor | named
named: name ':=' expr | expr
expr: disj ('if' disj 'else' expr)? | 'lambda' lambda_params? ':' expr
disj: negated (('and' | 'or') negated)*
negated: 'not'* bitor (compare bitor)*
compare: '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' 'not'?
bitor: operand (arith operand)*
arith: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^'
operand: ('+' | '-' | '~')* 'await'? atom trailer*
atom: name | NUMBER | STRING STRING* | '...' | 'None' | 'True' | 'False' | group | list | braces
trailer: '.' name | '[' slices ']' | '(' (args | named comp)? ')'
group: '(' (yield | named comp | named (',' star_named)* ','? | '*' bitor ',' (star_named (',' star_named)* ','?)?)? ')'
list: '[' (named comp | star_named (',' star_named)* ','?)? ']'
braces: '{' (pair (',' pair)* ','? | expr ':' expr comp | named comp | star_named (',' star_named)* ','?)? '}'
pair: expr ':' expr | '**' bitor
comp: 'async'? 'for' target_list 'in' disj ('if' disj)* comp?
slices: slice (',' slice)* ','?
slice: expr? ':' expr? (':' expr?)? | named | '*' bitor
args: positional (',' positional)* (',' keywords)? ','? | keywords ','?
positional: '*' expr | named
keywords: keyword (',' keyword)* (',' double (',' double)*)? | double (',' double)*
keyword: name '=' expr | '*' expr
double: '**' expr | name '=' expr
params: plist (',' special)? ','? | special ','?
plist: p (',' p)* (',' '/' (',' p)*)? (',' pd)* | p (',' p)* (',' pd)* ',' '/' (',' pd)* | pd (',' pd)* (',' '/' (',' pd)*)?
p: name (':' expr)?
pd: p '=' expr
special: '*' name (':' star)? (',' pk)* (',' '**' p)? | '*' ',' pk (',' pk)* (',' '**' p)? | '**' p
pk: p ('=' expr)?
lambda_params: lplist (',' lspecial)? ','? | lspecial ','?
lplist: name (',' name)* (',' '/' (',' name)*)? (',' lpd)* | name (',' name)* (',' lpd)* ',' '/' (',' lpd)* | lpd (',' lpd)* (',' '/' (',' lpd)*)?
lpd: name '=' expr
lspecial: '*' name (',' lpk)* (',' '**' name)? | '*' ',' lpk (',' lpk)* (',' '**' name)? | '**' name
lpk: name ('=' expr)?
typeparams: '[' typeparam (',' typeparam)* ','? ']'
typeparam: name (':' expr)? ('=' expr)? | '*' name ('=' star)? | '**' name ('=' expr)?
block: NEWLINE INDENT stmt stmt* DEDENT | line
compound: if | while | for | try | with | decorated | 'async' (for | with)
if: 'if' named ':' block ('elif' named ':' block)* else?
else: 'else' ':' block
while: 'while' named ':' block else?
for: 'for' target_list 'in' stars ':' block else?
try: 'try' ':' block (except except* else? finally? | except_star except_star* else? finally? | finally)
except: 'except' (expr ('as' name)?)? ':' block
except_star: 'except' '*' expr ('as' name)? ':' block
finally: 'finally' ':' block
with: 'with' ('(' with_item (',' with_item)* ','? ')' | with_item (',' with_item)*) ':' block
with_item: expr ('as' target)?
decorated: ('@' named NEWLINE)* (function | class)
function: 'async'? 'def' name typeparams? '(' params? ')' ('->' expr)? ':' block
class: 'class' name typeparams? ('(' args? ')')? ':' block
"""

# ---- tokens

_OPERATORS = "** // >> << -> := ... ! + - * / % & | ^ @ = < > ~ ( ) [ ] { } , : ; .".split() + [f"{o}=" for o in "** // >> << ! + - * / % & | ^ @ = < >".split()]
CLASS: dict[str, int] = {}
for _t in ["\0end", "\0newline", "\0indent", "\0dedent", "\0name", "\0number", "\0string", "\0error", *keyword.kwlist, "type", "match", "case", *_OPERATORS]:
    CLASS.setdefault(_t, len(CLASS) + 1)
del CLASS["!"]
END, NEWLINE, INDENT, DEDENT, NAME, NUMBER, STRING, ERROR = (CLASS.pop(x) for x in ("\0end", "\0newline", "\0indent", "\0dedent", "\0name", "\0number", "\0string", "\0error"))
_WIDTH = 128  # more than there are token classes
_OPEN, _CLOSE = {CLASS[x] for x in "([{"}, {CLASS[x] for x in ")]}"}
_NESTING = frozenset(_OPEN | _CLOSE)
_PAIR = {CLASS["("]: CLASS[")"], CLASS["["]: CLASS["]"], CLASS["{"]: CLASS["}"]}

_STRING = r"""(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''|"(?!"")(?:[^\\\n"]|\\[\s\S])*+"|'(?!'')(?:[^\\\n']|\\[\s\S])*+'|""(?!")|''(?!'))"""
_NUMBER = r"0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:(?:[0-9](?:_?[0-9])*+)?\.[0-9](?:_?[0-9])*+|[0-9](?:_?[0-9])*+\.?)(?:[eE][-+]?[0-9](?:_?[0-9])*+)?[jJ]?"
_OPERATOR = r"\*\*=?|//=?|>>=?|<<=?|->|:=|\.\.\.|[-+*/%&|^@=<>!]=?|[~()\[\]{},:;]|\.(?![0-9])"
TOKENS = re.compile(rf"""[ \t\f]*+(?:\\\n[ \t\f]*+)*+((?:(?:\#[^\n]*+)?\n[ \t\f]*+)++|[^\W\d]\w*+(?!["'])|{_OPERATOR}|{_NUMBER}|{_STRING}|[^\W\d]\w*+|[\s\S])""")
_RISKY = re.compile(r"\\[xuUN0-7]|[^\x00-\x7f]")
_NAME_RISK = re.compile(r"[^\x00-\x7f]")


@cache
def _indent(white: str) -> tuple[int, int]:
    """Columns of a line's start, with tabs to multiples of 8 and with tabs as 1."""
    col = alt = 0
    for ch in white:
        if ch == "\t":
            col, alt = (col // 8 + 1) * 8, alt + 1
        elif ch == "\f":
            col = alt = 0
        else:
            col, alt = col + 1, alt + 1
    return col, alt


def _classify(t: str) -> int:
    """Class of a token that is no keyword and no operator; negative: beyond the grammar."""
    c = t[0]
    if c.isalpha() or c == "_":
        if t[-1] in "\"'":
            prefix = t[: t.index(t[-1])].lower()
            beyond = ("f" in prefix and "{" in t or "f" in prefix and "}" in t) or "b" in prefix or ("r" not in prefix and _RISKY.search(t))
            return -STRING if beyond else STRING
        return NAME if t.isascii() or t.isidentifier() else ERROR
    if c.isdigit() or c == "." and len(t) > 1:
        if not t.isascii() or c == "0" and t.strip("0_") and t.replace("_", "").isdigit():
            return ERROR
        return -NUMBER if len(t) > 4000 else NUMBER
    if c in "\"'" and len(t) > 1:
        return -STRING if _RISKY.search(t) else STRING
    return NAME if t.isidentifier() else ERROR


# ---- languages


class Languages:
    """Interned nodes and their derivatives. Node 0 is the empty language, node 1 the empty word."""

    def __init__(self) -> None:
        self.rules = _parse_grammar()
        self.reset()

    def reset(self) -> None:
        self.nodes: list[tuple] = [("none",), ("word",)]
        self.ids: dict[tuple, int] = {}
        self.null: dict[int, bool] = {0: False, 1: True}
        self.step: dict[int, int] = {}
        self.built: dict[str, int] = {}
        self.start = self.ref("file")

    def intern(self, node: tuple) -> int:
        k = self.ids.get(node)
        if k is None:
            k = self.ids[node] = len(self.nodes)
            self.nodes.append(node)
        return k

    def ref(self, name: str) -> int:
        return self.intern(("ref", name))

    def tok(self, c: int) -> int:
        return self.intern(("tok", c))

    def seq(self, a: int, b: int) -> int:
        if a == 0 or b == 0:
            return 0
        if a == 1:
            return b
        if b == 1:
            return a
        node = self.nodes[a]
        return self.intern(("seq", node[1], self.seq(node[2], b))) if node[0] == "seq" else self.intern(("seq", a, b))

    def alt(self, parts) -> int:
        flat: set[int] = set()
        for p in parts:
            if self.nodes[p][0] == "alt":
                flat.update(self.nodes[p][1])
            elif p:
                flat.add(p)
        if len(flat) < 2:
            return flat.pop() if flat else 0
        return self.intern(("alt", tuple(sorted(flat))))

    def star(self, a: int) -> int:
        return self.intern(("star", a))

    def body(self, name: str) -> int:
        if name not in self.built:
            self.built[name] = self._build(self.rules[name])
        return self.built[name]

    def _build(self, e) -> int:
        kind = e[0]
        if kind == "tok":
            return self.tok(e[1])
        if kind == "ref":
            return self.ref(e[1])
        if kind == "alt":
            return self.alt([self._build(x) for x in e[1]])
        if kind == "star":
            return self.star(self._build(e[1]))
        if kind == "maybe":
            return self.alt([1, self._build(e[1])])
        out = 1
        for x in reversed(e[1]):
            out = self.seq(self._build(x), out)
        return out

    def nullable(self, k: int) -> bool:
        known = self.null.get(k)
        if known is None:
            node = self.nodes[k]
            self.null[k] = False  # the least solution; no rule of the grammar is nullable through itself
            known = self.null[k] = {
                "tok": lambda: False,
                "star": lambda: True,
                "ref": lambda: self.nullable(self.body(node[1])),
                "seq": lambda: self.nullable(node[1]) and self.nullable(node[2]),
                "alt": lambda: any(self.nullable(x) for x in node[1]),
            }[node[0]]()
        return known

    def derive(self, k: int, c: int) -> int:
        """The derivative of node ``k`` by token class ``c``."""
        at = k * _WIDTH + c
        out = self.step.get(at)
        if out is not None:
            return out
        node = self.nodes[k]
        kind = node[0]
        if kind == "tok":
            out = 1 if node[1] == c else 0
        elif kind == "ref":
            out = self.derive(self.body(node[1]), c)
        elif kind == "star":
            out = self.seq(self.derive(node[1], c), k)
        elif kind == "alt":
            out = self.alt([self.derive(x, c) for x in node[1]])
        elif kind == "seq":
            out = self.seq(self.derive(node[1], c), node[2])
            if self.nullable(node[1]):
                out = self.alt([out, self.derive(node[2], c)])
        else:
            out = 0
        self.step[at] = out
        return out


def _parse_grammar() -> dict[str, tuple]:
    names = {"END": END, "NEWLINE": NEWLINE, "INDENT": INDENT, "DEDENT": DEDENT, "NAME": NAME, "NUMBER": NUMBER, "STRING": STRING}
    lexeme = re.compile(r"'([^']+)'|(\w+)|([()|*?])")
    rules: dict[str, tuple] = {}
    for text in GRAMMAR.strip().splitlines():
        rule, _, right = text.partition(":")
        parts = [m.groups() for m in lexeme.finditer(right)]
        at = 0

        def choice() -> tuple:
            nonlocal at
            found = [sequence()]
            while at < len(parts) and parts[at][2] == "|":
                at += 1
                found.append(sequence())
            return ("alt", found) if len(found) > 1 else found[0]

        def sequence() -> tuple:
            nonlocal at
            found = []
            while at < len(parts) and parts[at][2] not in ("|", ")"):
                literal, word, sign = parts[at]
                at += 1
                if literal is not None:
                    item = ("tok", CLASS[literal])
                elif word is not None:
                    item = ("tok", names[word]) if word in names else ("ref", word)
                else:
                    item = choice()
                    at += 1
                while at < len(parts) and parts[at][2] in ("*", "?"):
                    item = ("star", item) if parts[at][2] == "*" else ("maybe", item)
                    at += 1
                found.append(item)
            return ("seq", found)

        rules[rule.strip()] = choice()
    return rules


class Outcome(NamedTuple):
    """valid: in the language. token: number of the first wrong token, or -1. line: its line (from 1), or 0.
    truncated: all tokens fit, but the text may not end here. beyond: holds what the grammar leaves aside."""

    valid: bool
    token: int
    line: int
    truncated: bool
    beyond: bool


_languages: Languages | None = None


def parse(text: str) -> Outcome:
    """Parse a text as a Python module."""
    global _languages
    if _languages is None or len(_languages.nodes) > MEMO_NODES:
        _languages = Languages()
    lang = _languages
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.endswith("\n"):
        text += "\n"
    state, derive, step, get = lang.start, lang.derive, lang.step.get, CLASS.get
    beyond = False
    depth: list[int] = []
    indents, alts = [0], [0]
    found = TOKENS.findall(text)
    first = found[0] if found else ""
    number, line = -1, 1
    fresh = True  # at the start of a logical line
    if first[:1] not in "\n#" and text[:1] in " \t\f":
        found.insert(0, "\n" + text[: len(text) - len(text.lstrip(" \t\f"))])
        line = 0
    total = len(found)
    for number, t in enumerate(found):
        c = get(t)
        if c is None:
            ch = t[0]
            if ch == "\n" or ch == "#":
                line += t.count("\n")
                if depth:
                    continue
                if not fresh:
                    state = step(state * _WIDTH + NEWLINE)
                    state = derive(lang_prev, NEWLINE) if state is None else state  # noqa: F821
                    if not state:
                        last = number == total - 1
                        return Outcome(False, -1 if last else number, 0 if last else line - t.count("\n"), last, beyond)
                    lang_prev = state
                    fresh = True
                if number == total - 1:
                    break
                white = t[t.rindex("\n") + 1 :]
                col, alt = _indent(white)
                if col == indents[-1]:
                    if alt != alts[-1]:
                        return Outcome(False, number, line, False, beyond)
                elif col > indents[-1]:
                    if alt <= alts[-1] or len(indents) >= 100:
                        return Outcome(False, number, line, False, beyond)
                    indents.append(col)
                    alts.append(alt)
                    state = derive(state, INDENT)
                else:
                    while col < indents[-1]:
                        indents.pop()
                        alts.pop()
                        state = derive(state, DEDENT)
                    if col != indents[-1] or alt != alts[-1]:
                        return Outcome(False, number, line, False, beyond)
                if not state:
                    return Outcome(False, number, line, False, beyond)
                lang_prev = state
                continue
            c = _classify(t)
            if c < 0:
                beyond, c = True, -c
            if c == STRING and "\n" in t:
                line += t.count("\n")
            if c == ERROR:
                # A quotation mark that nothing closes before the text ends is a text cut off inside a string.
                rest = text.rstrip("\n")
                cut = ch in "\"'" and _open_to_end(found, number, rest)
                return Outcome(False, -1 if cut else number, 0 if cut else line, cut, beyond)
        elif c in _NESTING:
            if c in _OPEN:
                depth.append(_PAIR[c])
                if len(depth) > 199:
                    return Outcome(False, number, line, False, True)
            elif not depth or depth.pop() != c:
                return Outcome(False, number, line, False, beyond)
        if fresh and c == _MATCH:
            beyond = True
        nxt = step(state * _WIDTH + c)
        if nxt is None:
            nxt = derive(state, c)
        if not nxt:
            return Outcome(False, number, line, False, beyond)
        state = lang_prev = nxt
        fresh = False
    if depth:
        return Outcome(False, -1, 0, True, beyond)
    for _ in indents[1:]:
        state = derive(state, DEDENT)
    end = derive(state, END)
    valid = bool(end) and lang.nullable(end)
    return Outcome(valid, -1, 0, not valid, beyond)


_MATCH = CLASS["match"]


def _open_to_end(found: list[str], number: int, text: str) -> bool:
    """Whether the stray quotation mark ``found[number]`` opens a string that runs to the end of ``text``."""
    rest = "".join(found[number:])
    if rest.startswith(('"""', "'''")) or found[number + 1 : number + 3] == [found[number]] * 2:
        return True
    return "\n" not in rest.rstrip("\n")
