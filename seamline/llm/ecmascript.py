"""Syntax check of JavaScript and TypeScript modules: a scanner and a recursive-descent recogniser.

Tokens are reduced to one character each, so that a block is a string: a block whose string was recognised
before, in the same context, is skipped.  The recogniser says whether a file is valid, and if not, the line
of the first token that no rule accepts; it builds no tree.
"""

from __future__ import annotations

import re

_KEYWORDS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
_CONTEXTUAL = "abstract any as asserts async await declare from get global implements infer interface is keyof let module namespace of out override package private protected public readonly require satisfies set static target type unique yield accessor never unknown undefined".split()
_PUNCT = "{ } ( ) [ ] ; , < > <= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... @ #".split()
_OTHER = ["id", "num", "str", "tpl", "tpl{", "}tpl{", "}tpl", "re", "#id", ">+", "eof"]
#: One character for each kind of token.
CODE = {k: chr(0x100 + i) for i, k in enumerate([*_KEYWORDS, *_CONTEXTUAL, *_PUNCT, *_OTHER])}
C = CODE
_ID_START = r"A-Za-z_$ª-﷿ﹰ-﻾Ａ-￮\U00010000-\U0010ffff"
_SCAN = re.compile(
    rf"(?P<nl>\r\n|[\n\r  ])|(?P<ws>[ \t\v\f\xa0﻿]+)|(?P<id>(?:[{_ID_START}]|\\u[0-9a-fA-F]{{4}})(?:[\w$‌‍]|\\u[0-9a-fA-F]{{4}})*)"
    r"|(?P<lc>//[^\n\r]*)|(?P<bc>/\*[\s\S]*?\*/)"
    r"|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<tick>`)|(?P<priv>\#[A-Za-z_$][\w$]*)"
    r"|(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
#: After one of these a slash divides; after anything else it opens a regular expression.
_ENDS_OPERAND = {C[k] for k in ("id", "num", "str", "tpl", "}tpl", "re", "#id", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", *_CONTEXTUAL)} - {C["of"], C["await"], C["yield"]}


class Invalid(Exception):
    """Raised with the index of the token that no rule accepts."""


#: What is left of a text that ends inside a string, a regular expression, a template or a comment.
_UNENDED = re.compile(r"[\"'/][^\n]*\Z|`|/\*|\}")


def scan(text: str, to_end: bool = False) -> tuple[str, str, list[int]]:
    """Kinds, line-break flags and offsets of the tokens; Invalid with the negated offset where none matches.

    ``to_end`` takes a token that the end of the text cuts off as the end.
    """
    kinds: list[str] = []
    breaks: list[str] = []
    at: list[int] = []
    pos, n, br, prev = 0, len(text), "0", ""
    braces: list[bool] = []
    parens: list[bool] = []
    closed_head = False
    if text.startswith("#!"):
        pos = text.find("\n")
        pos = n if pos < 0 else pos
    match, code, get = _SCAN.match, CODE, CODE.get
    ident, conditional = code["id"], {code[k] for k in ("if", "while", "for", "with")}
    while pos < n:
        m = match(text, pos)
        if m is None:
            if to_end and _UNENDED.match(text, pos):
                break
            raise Invalid(-pos - 1)
        g = m.lastgroup
        if g == "ws" or g == "lc":
            pos = m.end()
            continue
        if g == "nl":
            br, pos = "1", m.end()
            continue
        if g == "bc":
            if "\n" in m.group():
                br = "1"
            pos = m.end()
            continue
        if g == "id":
            k = get(m.group(), ident)
        elif g == "op":
            v = m.group()
            if v == "/" or v == "/=":
                if prev not in _ENDS_OPERAND or (prev == code[")"] and closed_head):
                    m = _REGEX.match(text, pos)
                    if m is None:
                        if to_end and _UNENDED.match(text, pos):
                            break
                        raise Invalid(-pos - 1)
                    k = code["re"]
                else:
                    k = code[v]
            elif v == "{":
                braces.append(False)
                k = code[v]
            elif v == "}":
                if braces and braces.pop():
                    t = _TPL.match(text, pos + 1)
                    if t is None:
                        if to_end:
                            break
                        raise Invalid(-pos - 1)
                    if t.group(1) == "`":
                        k = code["}tpl"]
                    else:
                        braces.append(True)
                        k = code["}tpl{"]
                    m = t
                else:
                    k = code[v]
            elif v == ">":
                k = code[">+"] if text[pos + 1 : pos + 2] in (">", "=") and text[pos + 1 : pos + 3] != "=>" else code[v]
            else:
                k = code[v]
                if v == "(":
                    parens.append(prev in conditional)
                elif v == ")":
                    closed_head = bool(parens) and parens.pop()
        elif g == "tick":
            t = _TPL.match(text, pos + 1)
            if t is None:
                if to_end:
                    break
                raise Invalid(-pos - 1)
            if t.group(1) == "`":
                k = code["tpl"]
            else:
                braces.append(True)
                k = code["tpl{"]
            m = t
        elif g == "priv":
            k = code["#id"]
        else:
            k = code[g]
        # a keyword behind a dot is a name
        if prev == code["."] or prev == code["?."]:
            if g == "id":
                k = ident
        kinds.append(k)
        breaks.append(br)
        at.append(pos)
        br, prev, pos = "0", k, m.end()
    kinds.append(code["eof"])
    breaks.append("1")
    at.append(n)
    return "".join(kinds), "".join(breaks), at


def _set(words: str) -> frozenset[str]:
    return frozenset(C[w] for w in words.split())


_IDENT = frozenset(C[w] for w in ("id", *_CONTEXTUAL))
_NAME = _IDENT | frozenset(C[w] for w in _KEYWORDS)
_PROP = _NAME | _set("str num #id")
_UNARY = _set("+ - ! ~ typeof void delete")
_ASSIGN = _set("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=")
_BINARY = _set("+ - * / % ** << < <= == != === !== & | ^ && || ?? instanceof")
_LITERAL = _set("num str tpl re null true false this super")
_STARTS = _IDENT | _LITERAL | _UNARY | _set("( [ { function class new tpl{ < ++ -- import async await #id @")
_MODIFIER = _set("public private protected static abstract override readonly declare accessor async")
_AFTER_TYPE_ARGS = _set("( tpl tpl{ ) ] } : ; , . ?. == != === !== & | ^ && || ?? = eof > ?")
_SPEC = _set("> >+")

#: Blocks recognised so far, by context; emptied when it grows beyond the bound.
_SEEN: set[tuple] = set()
_SEEN_MAX = 200_000


class _Parser:
    def __init__(self, kinds: str, breaks: str, ts: bool, to_end: bool = False) -> None:
        if to_end:
            kinds, breaks = kinds + C["eof"], breaks + "1"
        self.k, self.b, self.ts, self.i, self.to_end, self.ended = kinds, breaks, ts, 0, to_end, False
        # context: inside a function, an async one, a generator, a loop, a switch; no 'in' operator; ambient
        self.fn = self.asy = self.gen = self.loop = self.sw = self.noin = self.ambient = self.labels = 0
        self.asy = 1
        self.pair = self._pairs()

    def _pairs(self) -> dict[int, int]:
        opened, pair = [], {}
        openers, closers = {C["{"]: C["}"], C["("]: C[")"], C["["]: C["]"], C["tpl{"]: "", C["}tpl{"]: ""}, {C["}"], C[")"], C["]"], C["}tpl"]}
        mid = C["}tpl{"]
        for j, c in enumerate(self.k):
            if c == mid or c in closers:
                if not opened:
                    raise Invalid(j)
                o = opened.pop()
                want = openers[self.k[o]]
                if want != c and not (want == "" and c in (mid, C["}tpl"])):
                    raise Invalid(j)
                pair[o] = j
            if c in openers:
                opened.append(j)
        if opened and not self.to_end:
            raise Invalid(len(self.k) - 1)
        pair.update((o, len(self.k) - 2) for o in opened)
        return pair

    # --- tools
    def fail(self) -> None:
        if self.k[self.i] == C["eof"]:
            self.ended = True
        raise Invalid(self.i)

    def at(self, w: str) -> bool:
        return self.k[self.i] == C[w]

    def eat(self, w: str) -> bool:
        if self.k[self.i] == C[w]:
            self.i += 1
            return True
        return False

    def need(self, w: str) -> None:
        if self.k[self.i] != C[w]:
            self.fail()
        self.i += 1

    def nl(self) -> bool:
        return self.b[self.i] == "1"

    def semi(self) -> None:
        c = self.k[self.i]
        if c == C[";"]:
            self.i += 1
        elif c != C["}"] and c != C["eof"] and self.b[self.i] == "0":
            self.fail()

    def tries(self, rule) -> bool:
        i = self.i
        try:
            rule()
            return True
        except Invalid:
            self.i = i
            return False

    def ident(self) -> None:
        if self.k[self.i] not in _IDENT:
            self.fail()
        self.i += 1

    # --- statements
    def program(self) -> None:
        while not self.at("eof"):
            self.statement(True)

    def block(self) -> None:
        """A braced list of statements."""
        i = self.i
        if self.k[i] != C["{"]:
            self.fail()
        j = self.pair[i]
        key = (self.k[i : j + 1], self.b[i : j + 1], self.ts, self.fn, self.asy, self.gen, self.loop > 0, self.sw > 0, self.ambient, self.labels > 0)
        if key in _SEEN:
            self.i = j + 1
            return
        noin, self.noin = self.noin, 0
        self.i += 1
        while self.k[self.i] != C["}"]:
            self.statement(False)
        self.noin = noin
        if self.i != j:
            self.fail()
        self.i += 1
        if len(_SEEN) >= _SEEN_MAX:
            _SEEN.clear()
        _SEEN.add(key)

    def body(self, asy: int = 0, gen: int = 0) -> None:
        saved = self.fn, self.asy, self.gen, self.loop, self.sw, self.labels
        self.fn, self.asy, self.gen, self.loop, self.sw, self.labels = 1, asy, gen, 0, 0, 0
        self.block()
        self.fn, self.asy, self.gen, self.loop, self.sw, self.labels = saved

    def statement(self, top: bool) -> None:
        c, k = self.k[self.i], self.k
        if c == C["{"]:
            return self.block()
        rule = _STATEMENT.get(c)
        if rule is not None:
            return rule(self)
        if c == C["import"] and k[self.i + 1] not in (C["("], C["."]):
            return self.imports() if top else self.fail()
        if c == C["export"]:
            return self.exports() if top or self.ambient else self.fail()
        if c == C["let"] and (k[self.i + 1] in _IDENT or k[self.i + 1] in (C["["], C["{"])):
            return self.variables()
        if c == C["async"] and k[self.i + 1] == C["function"] and self.b[self.i + 1] == "0":
            self.i += 1
            return self.function(True, 1)
        if c == C["@"]:
            self.decorators()
            return self.statement(top)
        if self.ts and self.ts_statement(c, top):
            return None
        if c in _IDENT and k[self.i + 1] == C[":"]:
            self.i += 2
            self.labels += 1
            self.statement(False)
            self.labels -= 1
            return None
        if c in (C["else"], C["case"], C["default"], C["catch"], C["finally"], C["enum"], C["extends"], C["in"], C["instanceof"]):
            self.fail()
        self.expression()
        self.semi()
        return None

    def ts_statement(self, c: str, top: bool) -> bool:
        k, i = self.k, self.i
        nxt, same = k[i + 1], self.b[i + 1] == "0"
        if c == C["interface"] and nxt in _IDENT and same:
            self.i += 2
            self.type_params()
            if self.eat("extends"):
                self.type_list()
            self.object_type()
            return True
        if c == C["type"] and nxt in _IDENT and same:
            self.i += 2
            self.type_params()
            self.need("=")
            self.type()
            self.semi()
            return True
        if c == C["enum"]:
            self.enum()
            return True
        if c == C["abstract"] and nxt == C["class"]:
            self.i += 1
            self.klass(True)
            return True
        if c == C["declare"] and same and nxt in _DECLARED:
            self.i += 1
            self.ambient += 1
            if self.at("global") and k[self.i + 1] == C["{"]:
                self.i += 1
                self.module_block()
            else:
                self.statement(top)
            self.ambient -= 1
            return True
        if c in (C["namespace"], C["module"]) and (nxt in _IDENT or nxt == C["str"]) and same:
            self.i += 2
            while self.eat("."):
                self.ident()
            if self.at("{"):
                self.module_block()
            else:
                self.semi()
            return True
        return False

    def module_block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement(True)

    def enum(self) -> None:
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.at("}"):
            if self.k[self.i] in _PROP:
                self.i += 1
            elif self.eat("["):
                self.assignment()
                self.need("]")
            else:
                self.fail()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                break
        self.need("}")

    def variables(self, head: bool = False) -> None:
        constant = self.at("const")
        self.i += 1
        if constant and self.ts and self.at("enum"):
            return self.enum()
        while True:
            pattern = self.binding()
            if self.ts:
                if self.at("!") and self.k[self.i + 1] == C[":"]:
                    self.i += 1
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif not self.ambient and (constant or pattern) and not (head and (self.at("of") or self.at("in"))):
                self.fail()
            if not self.eat(","):
                break
        if not head:
            self.semi()
        return None

    def binding(self) -> bool:
        """A name or a pattern; True for a pattern."""
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    self.binding()
                else:
                    self.binding()
                    if self.eat("="):
                        self.with_in(self.assignment)
                if not self.at("]"):
                    self.need(",")
            self.i += 1
            return True
        if self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    c = self.k[self.i]
                    if c == C["["]:
                        self.i += 1
                        self.with_in(self.assignment)
                        self.need("]")
                        self.need(":")
                        self.binding()
                    elif c in _PROP:
                        self.i += 1
                        if self.eat(":"):
                            self.binding()
                        elif c not in _IDENT:
                            self.fail()
                    else:
                        self.fail()
                    if self.eat("="):
                        self.with_in(self.assignment)
                if not self.at("}"):
                    self.need(",")
            self.i += 1
            return True
        self.ident()
        return False

    def with_in(self, rule) -> None:
        noin, self.noin = self.noin, 0
        rule()
        self.noin = noin

    def s_if(self) -> None:
        self.i += 1
        self.paren()
        self.statement(False)
        if self.eat("else"):
            self.statement(False)

    def paren(self) -> None:
        self.need("(")
        self.with_in(self.expression)
        self.need(")")

    def s_for(self) -> None:
        self.i += 1
        if self.at("await"):
            self.i += 1
        self.need("(")
        if self.eat(";"):
            self.for_rest()
        else:
            c = self.k[self.i]
            self.noin += 1
            if c in (C["var"], C["const"]) or (c == C["let"] and (self.k[self.i + 1] in _IDENT or self.k[self.i + 1] in (C["["], C["{"]))):
                self.variables(True)
            else:
                self.expression()
            self.noin -= 1
            if self.eat("of"):
                self.assignment()
            elif self.eat("in"):
                self.expression()
            else:
                self.need(";")
                self.for_rest()
        self.need(")")
        self.loop += 1
        self.statement(False)
        self.loop -= 1

    def for_rest(self) -> None:
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.loop += 1
        self.statement(False)
        self.loop -= 1

    def s_do(self) -> None:
        self.i += 1
        self.loop += 1
        self.statement(False)
        self.loop -= 1
        self.need("while")
        self.paren()
        self.eat(";")

    def s_jump(self) -> None:
        cont = self.at("continue")
        self.i += 1
        if self.k[self.i] in _IDENT and not self.nl():
            if not self.labels:
                self.fail()
            self.i += 1
        elif not self.loop and (cont or not self.sw):
            self.fail()
        self.semi()

    def s_return(self) -> None:
        if not self.fn:
            self.fail()
        self.i += 1
        c = self.k[self.i]
        if c != C[";"] and c != C["}"] and c != C["eof"] and not self.nl():
            self.expression()
        self.semi()

    def s_throw(self) -> None:
        self.i += 1
        if self.nl():
            self.fail()
        self.expression()
        self.semi()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        if self.eat("catch"):
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
            if self.eat("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        self.sw += 1
        while not self.at("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.k[self.i] not in (C["case"], C["default"], C["}"]):
                self.statement(False)
        self.sw -= 1
        self.i += 1

    def s_empty(self) -> None:
        self.i += 1

    def s_debugger(self) -> None:
        self.i += 1
        self.semi()

    def s_function(self) -> None:
        self.function(True, 0)

    def s_class(self) -> None:
        self.klass(True)

    def imports(self) -> None:
        self.i += 1
        if self.eat("str"):
            return self.attributes()
        if self.ts and self.at("type") and self.k[self.i + 1] not in (C["from"], C[","], C["="]):
            self.i += 1
        if self.k[self.i] in _IDENT:
            self.i += 1
            if self.ts and self.eat("="):
                if self.at("require") and self.k[self.i + 1] == C["("]:
                    self.i += 2
                    self.need("str")
                    self.need(")")
                else:
                    self.ident()
                    while self.eat("."):
                        self.ident()
                return self.semi()
            if not self.eat(","):
                self.need("from")
                self.need("str")
                return self.attributes()
        if self.eat("*"):
            self.need("as")
            self.ident()
        else:
            self.specifiers()
        self.need("from")
        self.need("str")
        return self.attributes()

    def attributes(self) -> None:
        if self.at("with"):
            self.i += 1
            self.expression()
        self.semi()

    def specifiers(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.ts and self.at("type") and self.k[self.i + 1] in _NAME and self.k[self.i + 1] != C["as"]:
                self.i += 1
            if self.k[self.i] not in _NAME and not self.at("str"):
                self.fail()
            self.i += 1
            if self.eat("as"):
                if self.k[self.i] not in _NAME and not self.at("str"):
                    self.fail()
                self.i += 1
            if not self.eat(","):
                break
        self.need("}")

    def exports(self) -> None:
        self.i += 1
        c = self.k[self.i]
        if c == C["default"]:
            self.i += 1
            c = self.k[self.i]
            if c == C["function"]:
                self.function(False, 0)
            elif c == C["async"] and self.k[self.i + 1] == C["function"] and self.b[self.i + 1] == "0":
                self.i += 1
                self.function(False, 1)
            elif c == C["class"] or c == C["@"]:
                self.decorators()
                self.klass(False)
            elif self.ts and c == C["abstract"] and self.k[self.i + 1] == C["class"]:
                self.i += 1
                self.klass(False)
            elif self.ts and c == C["interface"] and self.k[self.i + 1] in _IDENT:
                self.ts_statement(c, True)
            else:
                self.assignment()
                self.semi()
            return None
        if c == C["*"]:
            self.i += 1
            if self.eat("as"):
                if self.k[self.i] not in _NAME and not self.at("str"):
                    self.fail()
                self.i += 1
            self.need("from")
            self.need("str")
            return self.attributes()
        if self.ts and c == C["type"] and self.k[self.i + 1] in (C["{"], C["*"]):
            self.i += 1
            if self.eat("*"):
                if self.eat("as"):
                    self.ident()
                self.need("from")
                self.need("str")
                return self.attributes()
        if self.at("{"):
            self.specifiers()
            if self.eat("from"):
                self.need("str")
                return self.attributes()
            return self.semi()
        if self.ts and c == C["="]:
            self.i += 1
            self.expression()
            return self.semi()
        if self.ts and c == C["as"] and self.k[self.i + 1] == C["namespace"]:
            self.i += 2
            self.ident()
            return self.semi()
        if self.ts and c == C["import"]:
            return self.imports()
        if c in (C["var"], C["const"], C["let"]):
            return self.variables()
        if c in (C["function"], C["class"], C["@"]) or (c == C["async"] and self.k[self.i + 1] == C["function"]):
            return self.statement(True)
        if self.ts and self.ts_statement(c, True):
            return None
        return self.fail()

    # --- functions and classes
    def function(self, named: bool, asy: int) -> None:
        self.need("function")
        gen = int(self.eat("*"))
        if self.k[self.i] in _IDENT:
            self.i += 1
        elif named:
            self.fail()
        self.signature()
        if self.ts and not self.at("{"):
            return self.semi()  # an overload or an ambient function
        return self.body(asy, gen)

    def signature(self) -> None:
        if self.ts:
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.type(True)

    def params(self) -> None:
        self.need("(")
        self.with_in(self._params)

    def _params(self) -> None:
        while not self.at(")"):
            self.decorators()
            if self.ts:
                while self.k[self.i] in _MODIFIER and (self.k[self.i + 1] in _IDENT or self.k[self.i + 1] in (C["{"], C["["])):
                    self.i += 1
                if self.at("this") and self.k[self.i + 1] == C[":"]:
                    self.i += 2
                    self.type()
                    if not self.at(")"):
                        self.need(",")
                    continue
            rest = self.eat("...")
            self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                if rest:
                    self.fail()
                self.assignment()
            if self.at(")"):
                break
            if rest:
                self.fail()
            self.need(",")
        self.i += 1

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.paren()
                continue
            self.ident()
            while self.eat("."):
                self.i += 1
            if self.at("("):
                self.arguments()

    def klass(self, named: bool) -> None:
        self.need("class")
        if self.k[self.i] in _IDENT and not (self.at("implements") and self.k[self.i + 1] in _IDENT):
            self.i += 1
        elif named:
            self.fail()
        if self.ts:
            self.type_params()
        if self.eat("extends"):
            self.unary()
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type_list()
        i = self.i
        if self.k[i] != C["{"]:
            self.fail()
        j = self.pair[i]
        key = (self.k[i : j + 1], self.b[i : j + 1], self.ts, "class", self.ambient)
        if key in _SEEN:
            self.i = j + 1
            return
        self.i += 1
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()
        if len(_SEEN) >= _SEEN_MAX:
            _SEEN.clear()
        _SEEN.add(key)

    def member(self) -> None:
        self.decorators()
        k = self.k
        ends = (C["("], C["="], C[";"], C["}"], C[":"], C["?"], C["!"], C["<"])
        if self.at("static") and k[self.i + 1] == C["{"]:
            self.i += 1
            return self.body(0, 0)
        asy = gen = 0
        while k[self.i] in (_MODIFIER if self.ts else _JS_MODIFIER) and k[self.i + 1] not in ends and not (self.b[self.i + 1] == "1" and self.at("async")):
            if self.at("async"):
                asy = 1
            if self.b[self.i + 1] == "1" and not self.ts and not self.at("static"):
                break
            self.i += 1
        if self.eat("*"):
            gen = 1
        access = False
        if k[self.i] in (C["get"], C["set"]) and k[self.i + 1] not in ends and k[self.i + 1] not in (C[","],):
            self.i += 1
            access = True
        if self.ts and self.at("[") and k[self.i + 1] in _IDENT and k[self.i + 2] == C[":"]:
            self.i += 3
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            return self.semi()
        self.property_name()
        if self.ts and (self.at("?") or self.at("!")):
            self.i += 1
        if self.at("(") or (self.ts and self.at("<")):
            self.signature()
            if self.ts and not self.at("{"):
                return self.semi()
            return self.body(asy, gen)
        if access or asy or gen:
            self.fail()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            saved, self.fn = self.fn, 0
            self.with_in(self.assignment)
            self.fn = saved
        return self.semi()

    def property_name(self) -> None:
        if self.eat("["):
            self.with_in(self.assignment)
            self.need("]")
        elif self.k[self.i] in _PROP:
            self.i += 1
        else:
            self.fail()

    # --- expressions
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def arrow_body(self, asy: int) -> None:
        if self.at("{"):
            self.body(asy, 0)
        else:
            saved, self.asy = self.asy, asy
            self.assignment()
            self.asy = saved

    def arrow(self) -> bool:
        """An arrow function if one stands here."""
        k, i = self.k, self.i
        asy = 0
        if k[i] == C["async"] and self.b[i + 1] == "0" and (k[i + 1] in _IDENT or k[i + 1] in (C["("], C["<"])) and k[i + 1] != C["in"]:
            if k[i + 1] in _IDENT:
                if k[i + 2] != C["=>"]:
                    return False
                self.i += 3
                self.arrow_body(1)
                return True
            asy, i = 1, i + 1
        c = k[i]
        if c in _IDENT:
            if k[i + 1] == C["=>"] and self.b[i + 1] == "0":
                self.i = i + 2
                self.arrow_body(asy)
                return True
            return False
        if c == C["("]:
            after = k[self.pair[i] + 1]
            if self.to_end and k[self.pair[i]] == C["eof"] and self.ts:
                start = self.i
                self.i = i
                self.tries(self.params)
                self.i = start
            if after == C["=>"]:
                self.i = i
                self.params()
                self.need("=>")
                self.arrow_body(asy)
                return True
            if not (self.ts and after == C[":"]):
                return False
        elif not (c == C["<"] and self.ts):
            return False
        start = self.i

        def head() -> None:
            self.i = i
            self.signature()
            self.need("=>")

        if not self.tries(head):
            self.i = start
            return False
        self.arrow_body(asy)
        return True

    def assignment(self) -> None:
        c = self.k[self.i]
        if c == C["yield"] and self.gen:
            self.i += 1
            if self.eat("*"):
                return self.assignment()
            if not self.nl() and self.k[self.i] in _STARTS:
                self.assignment()
            return None
        if (c in _IDENT or c == C["("] or c == C["<"]) and self.arrow():
            return None
        target = self.binary()
        c = self.k[self.i]
        if c == C["?"]:
            self.i += 1
            self.with_in(self.assignment)
            self.need(":")
            return self.assignment()
        if c in _ASSIGN:
            if not target or (target == 2 and c != C["="]):
                self.fail()
            self.i += 1
            return self.assignment()
        if c in _SPEC and self.shift_assign():
            return self.assignment()
        return None

    def shift_assign(self) -> bool:
        i = self.i
        while self.k[i] == C[">+"]:
            i += 1
        if self.k[i] == C["="] and i - self.i >= 2:
            self.i = i + 1
            return True
        if self.k[i] == C[">"] and self.k[i + 1] == C["="] and i - self.i >= 1 and False:
            return True
        return False

    def greater(self) -> bool:
        """One of the operators that begin with '>', whose characters are scanned one by one."""
        i = self.i
        while self.k[i] == C[">+"]:
            i += 1
        n = i - self.i
        if self.k[i] == C[">"] and n <= 2:
            self.i = i + 1
            return True
        if self.k[i] == C["="] and n == 1:
            self.i = i + 1
            return True
        if self.k[i] == C["=="] and n == 1:
            return False
        return False

    def binary(self) -> int:
        target = self.unary()
        while True:
            c = self.k[self.i]
            if c in _BINARY:
                self.i += 1
            elif c == C["in"]:
                if self.noin:
                    return target
                self.i += 1
            elif c in _SPEC:
                if not self.greater():
                    return target
            elif self.ts and c in (C["as"], C["satisfies"]) and not self.nl():
                self.i += 1
                if not self.eat("const"):
                    self.type()
                target = 1
                continue
            else:
                return target
            self.unary()
            target = 0

    def unary(self) -> int:
        c = self.k[self.i]
        if c in _UNARY or (c == C["await"] and self.asy and self.k[self.i + 1] in _STARTS):
            self.i += 1
            self.unary()
            return 0
        if c == C["++"] or c == C["--"]:
            self.i += 1
            if self.unary() != 1:
                self.fail()
            return 0
        if self.ts and c == C["<"]:
            self.i += 1
            self.type()
            self.close_angle()
            self.unary()
            return 0
        target = self.postfix()
        c = self.k[self.i]
        if (c == C["++"] or c == C["--"]) and not self.nl():
            if target != 1:
                self.fail()
            self.i += 1
            return 0
        return target

    def arguments(self) -> None:
        self.need("(")
        noin, self.noin = self.noin, 0
        while not self.at(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.i += 1
        self.noin = noin

    def template(self) -> None:
        if self.eat("tpl"):
            return
        self.need("tpl{")
        while True:
            self.with_in(self.expression)
            if self.eat("}tpl"):
                return
            self.need("}tpl{")

    def postfix(self) -> int:
        target = self.primary()
        k = self.k
        while True:
            c = k[self.i]
            if c == C["."]:
                self.i += 1
                if k[self.i] not in _NAME and not self.at("#id"):
                    self.fail()
                self.i += 1
                target = 1
            elif c == C["?."]:
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.eat("["):
                    self.with_in(self.expression)
                    self.need("]")
                elif k[self.i] in _NAME or self.at("#id"):
                    self.i += 1
                else:
                    self.fail()
                target = 0
            elif c == C["["]:
                self.i += 1
                self.with_in(self.expression)
                self.need("]")
                target = 1
            elif c == C["("]:
                self.arguments()
                target = 0
            elif c == C["tpl"] or c == C["tpl{"]:
                self.template()
                target = 0
            elif self.ts and c == C["!"] and not self.nl():
                self.i += 1
                target = 1
            elif self.ts and c == C["<"]:
                i = self.i

                def generic() -> None:
                    self.type_args()
                    if self.k[self.i] not in _AFTER_TYPE_ARGS and not self.nl():
                        self.fail()

                if not self.tries(generic) or (self.k[self.i] not in _AFTER_TYPE_ARGS and False):
                    self.i = i
                    return target
                target = 0
            else:
                return target

    def primary(self) -> int:
        c = self.k[self.i]
        if c in _IDENT:
            if c == C["async"] and self.k[self.i + 1] == C["function"] and self.b[self.i + 1] == "0":
                self.i += 1
                self.function(False, 1)
                return 0
            self.i += 1
            return 1
        if c in _LITERAL:
            self.i += 1
            return 0
        if c == C["("]:
            self.i += 1
            noin, self.noin = self.noin, 0
            i = self.i
            self.expression()
            self.noin = noin
            self.need(")")
            return 1 if self.i - i <= 2 and self.k[i] in _IDENT or self.k[self.i - 2] in _IDENT else 0
        if c == C["["]:
            self.i += 1
            noin, self.noin = self.noin, 0
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if not self.at("]"):
                    self.need(",")
            self.i += 1
            self.noin = noin
            return 2
        if c == C["{"]:
            self.object()
            return 2
        if c == C["tpl{"]:
            self.template()
            return 0
        if c == C["function"]:
            self.function(False, 0)
            return 0
        if c == C["class"]:
            self.klass(False)
            return 0
        if c == C["@"]:
            self.decorators()
            self.klass(False)
            return 0
        if c == C["new"]:
            self.i += 1
            if self.eat("."):
                self.need("target") if self.at("target") else self.ident()
                return 0
            self.new_target()
            return 0
        if c == C["import"]:
            self.i += 1
            if self.eat("."):
                self.ident()
            elif self.at("("):
                self.arguments()
            else:
                self.fail()
            return 0
        if c == C["#id"] and self.k[self.i + 1] == C["in"]:
            self.i += 1
            return 0
        self.fail()
        return 0

    def new_target(self) -> None:
        if self.at("new"):
            self.i += 1
            self.new_target()
        else:
            self.primary()
        while True:
            if self.eat("."):
                if self.k[self.i] not in _NAME and not self.at("#id"):
                    self.fail()
                self.i += 1
            elif self.eat("["):
                self.with_in(self.expression)
                self.need("]")
            elif self.ts and self.at("!"):
                self.i += 1
            else:
                break
        if self.ts and self.at("<"):
            self.tries(self.type_args)
        if self.at("("):
            self.arguments()

    def object(self) -> None:
        self.need("{")
        noin, self.noin = self.noin, 0
        k = self.k
        while not self.at("}"):
            if self.eat("..."):
                self.assignment()
            else:
                c = k[self.i]
                asy = gen = 0
                ends = (C[":"], C["("], C[","], C["}"], C["="], C["<"])
                access = False
                if c == C["async"] and k[self.i + 1] not in ends and self.b[self.i + 1] == "0":
                    self.i += 1
                    asy = 1
                if self.eat("*"):
                    gen = 1
                if not asy and not gen and k[self.i] in (C["get"], C["set"]) and k[self.i + 1] not in ends:
                    self.i += 1
                    access = True
                c = k[self.i]
                self.property_name()
                if self.at("(") or (self.ts and self.at("<")):
                    self.signature()
                    self.body(asy, gen)
                elif asy or gen or access:
                    self.fail()
                elif self.eat(":"):
                    self.assignment()
                elif c in _IDENT:
                    if self.eat("="):
                        self.assignment()
                else:
                    self.fail()
            if not self.at("}"):
                self.need(",")
        self.i += 1
        self.noin = noin

    # --- types
    def close_angle(self) -> None:
        c = self.k[self.i]
        if c != C[">"] and c != C[">+"]:
            self.fail()
        self.i += 1

    def type_params(self) -> None:
        if not self.eat("<"):
            return
        while True:
            while self.k[self.i] in (C["const"], C["in"], C["out"]) and self.k[self.i + 1] in _IDENT:
                self.i += 1
            self.ident()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.k[self.i] in _SPEC:
                break
        self.close_angle()

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.close_angle()

    def type_list(self) -> None:
        while True:
            self.type_reference()
            if not self.eat(","):
                break

    def type_reference(self) -> None:
        if self.k[self.i] not in _IDENT and not self.at("this"):
            self.fail()
        self.i += 1
        while self.at("."):
            self.i += 1
            if self.k[self.i] not in _NAME:
                self.fail()
            self.i += 1
        if self.at("<") and not self.nl():
            self.type_args()

    def type(self, returned: bool = False) -> None:
        k, i = self.k, self.i
        if returned:
            if k[i] == C["asserts"] and (k[i + 1] in _IDENT or k[i + 1] == C["this"]) and self.b[i + 1] == "0":
                self.i += 2
                if self.eat("is"):
                    self.type()
                return
            if (k[i] in _IDENT or k[i] == C["this"]) and k[i + 1] == C["is"] and self.b[i + 1] == "0":
                self.i += 2
                self.type()
                return
        if self.function_type():
            return
        self.union()
        if self.at("extends") and not self.nl():
            self.i += 1
            self.union()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()
            else:
                self.fail()

    def function_type(self) -> bool:
        k, i = self.k, self.i
        if k[i] == C["abstract"] and k[i + 1] == C["new"]:
            i += 1
        if k[i] == C["new"]:
            i += 1
        if k[i] == C["("]:
            if k[self.pair[i] + 1] != C["=>"]:
                return False
        elif k[i] != C["<"]:
            return False
        self.i = i
        self.type_params()
        self.params()
        self.need("=>")
        self.type(True)
        return True

    def union(self) -> None:
        if self.at("|") or self.at("&"):
            self.i += 1
        while True:
            if not self.function_type():
                self.unary_type()
            if self.at("|") or self.at("&"):
                self.i += 1
            else:
                return

    def unary_type(self) -> None:
        k, i = self.k, self.i
        if k[i] in (C["keyof"], C["unique"], C["readonly"]) and k[i + 1] in _TYPE_STARTS:
            self.i += 1
            return self.unary_type()
        if k[i] == C["infer"] and k[i + 1] in _IDENT:
            self.i += 2
            if self.at("extends"):

                def constraint() -> None:
                    self.i += 1
                    self.union()
                    if self.at("?"):
                        self.fail()

                self.tries(constraint)
            return None
        if k[i] == C["typeof"]:
            self.i += 1
            if self.at("import"):
                return self.primary_type()
            if k[self.i] not in _IDENT and not self.at("this"):
                self.fail()
            self.i += 1
            while self.eat("."):
                self.i += 1
            if self.at("<") and not self.nl():
                self.type_args()
        else:
            self.primary_type()
        while self.at("[") and not self.nl():
            self.i += 1
            if not self.at("]"):
                self.type()
            self.need("]")
        return None

    def primary_type(self) -> None:
        c = self.k[self.i]
        if c in _IDENT or c == C["this"]:
            self.type_reference()
        elif c in (C["str"], C["num"], C["true"], C["false"], C["null"], C["void"], C["tpl"]):
            self.i += 1
        elif c == C["-"]:
            self.i += 1
            self.need("num")
        elif c == C["tpl{"]:
            self.i += 1
            while True:
                self.type()
                if self.eat("}tpl"):
                    break
                self.need("}tpl{")
        elif c == C["("]:
            self.i += 1
            self.type()
            self.need(")")
        elif c == C["{"]:
            self.object_type()
        elif c == C["["]:
            self.i += 1
            while not self.at("]"):
                self.eat("...")
                if self.k[self.i] in _NAME and (self.k[self.i + 1] == C[":"] or (self.k[self.i + 1] == C["?"] and self.k[self.i + 2] == C[":"])):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if not self.at("]"):
                    self.need(",")
            self.i += 1
        elif c == C["import"]:
            self.i += 1
            self.need("(")
            self.need("str")
            self.need(")")
            while self.eat("."):
                self.i += 1
            if self.at("<"):
                self.type_args()
        else:
            self.fail()

    def object_type(self) -> None:
        self.need("{")
        k = self.k
        while not self.at("}"):
            ends = (C["("], C[":"], C["?"], C[";"], C[","], C["}"], C["<"])
            if self.at("+") or self.at("-"):
                self.i += 1
            while k[self.i] in (C["readonly"], C["get"], C["set"]) and k[self.i + 1] not in ends:
                self.i += 1
            if self.at("new") and k[self.i + 1] in (C["("], C["<"]):
                self.i += 1
            if self.at("(") or self.at("<"):
                self.signature()
            elif self.at("[") and k[self.i + 1] in _IDENT and k[self.i + 2] == C["in"]:
                self.i += 3
                self.type()
                if self.eat("as"):
                    self.type()
                self.need("]")
                if self.at("+") or self.at("-"):
                    self.i += 1
                self.eat("?")
                if self.eat(":"):
                    self.type()
            elif self.at("[") and k[self.i + 1] in _IDENT and k[self.i + 2] == C[":"]:
                self.i += 3
                self.type()
                self.need("]")
                self.need(":")
                self.type()
            else:
                self.property_name()
                self.eat("?")
                if self.at("(") or self.at("<"):
                    self.signature()
                elif self.eat(":"):
                    self.type()
            if self.at("}"):
                break
            if not self.eat(";") and not self.eat(",") and not self.nl():
                self.fail()
        self.i += 1


_JS_MODIFIER = _set("static async accessor")
_TYPE_STARTS = _IDENT | _set("str num true false null void tpl tpl{ - ( { [ import typeof this")
_DECLARED = _set("const let var function class enum abstract interface type namespace module global async")
_STATEMENT = {
    C["var"]: _Parser.variables,
    C["const"]: _Parser.variables,
    C["function"]: _Parser.s_function,
    C["class"]: _Parser.s_class,
    C["if"]: _Parser.s_if,
    C["for"]: _Parser.s_for,
    C["while"]: _Parser.s_while,
    C["do"]: _Parser.s_do,
    C["break"]: _Parser.s_jump,
    C["continue"]: _Parser.s_jump,
    C["return"]: _Parser.s_return,
    C["throw"]: _Parser.s_throw,
    C["try"]: _Parser.s_try,
    C["switch"]: _Parser.s_switch,
    C[";"]: _Parser.s_empty,
    C["debugger"]: _Parser.s_debugger,
}


def check(text: str, typescript: bool) -> int | None:
    """None if ``text`` is a valid module, else the offset of the first token that cannot be accepted."""
    try:
        kinds, breaks, at = scan(text)
    except Invalid as e:
        return -e.args[0] - 1
    try:
        _Parser(kinds, breaks, typescript).program()
    except Invalid as e:
        return at[min(e.args[0], len(at) - 1)]
    return None


def ends_open(text: str, typescript: bool) -> bool:
    """Is ``text`` invalid only because it stops: does the recogniser accept it up to its end and want more?"""
    try:
        kinds, breaks, _ = scan(text, True)
        parser = _Parser(kinds, breaks, typescript, True)
    except Invalid:
        return False
    try:
        parser.program()
    except (Invalid, IndexError):
        return parser.ended
    return False
