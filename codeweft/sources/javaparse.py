"""Declarations of a Java compilation unit, read by a tolerant scanner.

No class path and no grammar tables: one regular expression splits the text
into comments, literals, words and punctuation; a small state machine walks
type bodies and skips method bodies by counting braces. Broken input yields
what could be read up to the break.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<doc>/\*\*(?!/).*?(?:\*/|\Z))|(?P<com>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<str>\"\"\".*?(?<!\\)\"\"\"|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<dots>\.\.\.|::|->)|(?P<p>[^\s\w])""",
    re.S,
)

# The modifiers of the language.
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
# Type keywords and the kind stored for them (records count as classes).
KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "@interface": "ANNOTATION", "record": "CLASS"}


@dataclass
class Call:
    """A call in a body. ``scope`` is what stands before the dot: '' for nothing or ``this``, None for an expression.

    ``scope_type`` and ``args`` are the types of variables, parameters and
    literals where the body tells them; an argument that is only a name is
    given as ``?name``, an unknown one as ''.
    """

    name: str
    argc: int
    at: int
    scope: str | None = ""
    scope_type: str = ""
    args: list[str] = field(default_factory=list)


@dataclass
class Decl:
    """One declaration: kind is ``type``, ``method`` or ``field``."""

    kind: str
    owner: str
    name: str
    doc: str | None
    start: int
    end: int
    line_start: int = 0
    line_end: int = 0
    type_kind: str = ""
    modifiers: tuple[str, ...] = ()
    returns: str = ""
    params: list[tuple[str, str]] = field(default_factory=list)
    has_body: bool = False
    supers: list[tuple[str, str]] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)


@dataclass
class Unit:
    package: str
    imports: list[str]
    decls: list[Decl]
    error: str | None = None


def simple_type(t: str) -> str:
    """``java.util.List<X>[]`` -> ``List``: no type arguments, brackets, ellipsis or package."""
    cut = t.find("<")
    if cut > 0:
        t = t[:cut]
    return t.replace("[]", "").replace("...", "").strip().rpartition(".")[2]


def method_id(owner: str, name: str, types: list[str]) -> str:
    return f"{owner}#{name}({','.join(map(simple_type, types))})"


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.val: list[str] = []
        self.pos: list[int] = []
        self.stop: list[int] = []
        for m in _TOKEN.finditer(text):
            self.kind.append(m.lastgroup)
            self.val.append(m.group())
            self.pos.append(m.start())
            self.stop.append(m.end())
        self.n = len(self.val)
        self.line = [0]
        self.line += [m.end() for m in re.finditer("\n", text)]
        self.decls: list[Decl] = []

    def code(self, i: int) -> bool:
        return self.kind[i] not in ("doc", "com")

    def next_code(self, i: int) -> int:
        while i < self.n and not self.code(i):
            i += 1
        return i

    def balanced(self, i: int, a: str, b: str) -> int:
        """Index after the bracket that closes the one at i."""
        depth, val, kind = 0, self.val, self.kind
        while i < self.n:
            if kind[i] == "p":
                if val[i] == a:
                    depth += 1
                elif val[i] == b:
                    depth -= 1
                    if depth == 0:
                        return i + 1
            i += 1
        return self.n

    def annotation(self, i: int) -> int:
        """Index after the annotation whose @ is at i."""
        i = self.next_code(i + 1)
        while i < self.n and self.kind[i] == "word":
            i += 1
            if i + 1 < self.n and self.val[i] == "." and self.kind[i + 1] == "word":
                i += 1
                continue
            break
        j = self.next_code(i)
        return self.balanced(j, "(", ")") if j < self.n and self.val[j] == "(" else i

    def span(self, i: int, j: int) -> str:
        """Tokens i..j-1 as one line of code without comments."""
        out: list[str] = []
        for k in range(i, j):
            if not self.code(k):
                continue
            if out and (self.kind[k] in ("word", "num") and (out[-1][-1:].isalnum() or out[-1][-1:] in "_$>]?") or out[-1] in (",", "&") or self.val[k] in ("&",)):
                out.append(" ")
            out.append(self.val[k])
        return "".join(out)

    def members(self, i: int, owner: str, kind: str, simple: str) -> int:
        """Read a type body whose first token is at i; index after its closing brace."""
        val, kinds = self.val, self.kind
        if kind == "enum":
            i = self.constants(i)
        doc: str | None = None
        while i < self.n:
            k = kinds[i]
            if k == "doc":
                doc, i = val[i], i + 1
            elif k == "com":
                doc, i = None, i + 1
            elif val[i] == "}":
                return i + 1
            elif val[i] == ";":
                doc, i = None, i + 1
            elif val[i] == "@" and not (i + 1 < self.n and val[i + 1] == "interface"):
                i = self.annotation(i)
            else:
                i = self.member(i, owner, kind, simple, doc)
                doc = None
        return i

    def constants(self, i: int) -> int:
        """Skip the constants of an enum: up to after the ';' or before the closing '}'."""
        while i < self.n:
            v = self.val[i]
            if self.kind[i] == "p":
                if v == "(":
                    i = self.balanced(i, "(", ")")
                    continue
                if v == "{":
                    i = self.balanced(i, "{", "}")
                    continue
                if v == ";":
                    return i + 1
                if v == "}":
                    return i
            i += 1
        return i

    def member(self, i: int, owner: str, kind: str, simple: str, doc: str | None) -> int:
        val, kinds, n = self.val, self.kind, self.n
        first, mods, words, angle = i, [], [], 0
        while i < n:
            v, k = val[i], kinds[i]
            if not self.code(i):
                i += 1
            elif v == "@" and not (i + 1 < n and val[i + 1] == "interface"):
                i = self.annotation(i)
            elif v == "@" and i + 1 < n and val[i + 1] == "interface":
                return self.type_decl(first, i + 2, "@interface", owner, mods, doc)
            elif k == "word" and not angle and v in ("class", "interface", "enum") and not words:
                return self.type_decl(first, i + 1, v, owner, mods, doc)
            elif k == "word" and not angle and v == "record" and not words and self.is_record(i):
                return self.type_decl(first, i + 1, v, owner, mods, doc)
            elif k == "word":
                if v in MODIFIERS and not angle and not words:
                    mods.append(v)
                else:
                    words.append(i)
                i += 1
            elif v == "<":
                angle += 1
                i += 1
            elif v == ">":
                angle -= 1
                i += 1
            elif v == "(" and not angle:
                return self.method(first, i, owner, simple, mods, words, doc)
            elif v == "{":  # an initialiser, or the body of a compact constructor
                return self.balanced(i, "{", "}")
            elif v in (";", "=") and not angle or v == "," and not angle:
                return self.fields(first, i, owner, mods, words, doc)
            elif v == "}":
                return i
            else:
                i += 1
        return n

    def is_record(self, i: int) -> bool:
        j = self.next_code(i + 1)
        k = self.next_code(j + 1)
        return j < self.n and self.kind[j] == "word" and k < self.n and self.val[k] in ("(", "<")

    def type_decl(self, first: int, i: int, kind: str, owner: str, mods: list[str], doc: str | None) -> int:
        i = self.next_code(i)
        if i >= self.n or self.kind[i] != "word":
            return i
        name, depth = self.val[i], 0
        full = f"{owner}.{name}" if owner else name
        d = Decl("type", owner, full, doc, self.pos[first], self.pos[first], type_kind=KINDS[kind], modifiers=tuple(mods))
        self.decls.append(d)
        i += 1
        role, begin, lists = "", i, []
        while i < self.n and not (self.val[i] == "{" and depth == 0 and self.kind[i] == "p"):
            v = self.val[i]
            if v in ("(", "[") and self.kind[i] == "p":
                i = self.balanced(i, v, ")" if v == "(" else "]")
                continue
            if v == "@":
                i = self.annotation(i)
                continue
            if v == "<":
                depth += 1
            elif v == ">":
                depth -= 1
            elif depth == 0 and self.kind[i] == "word" and v in ("extends", "implements", "permits"):
                lists.append((role, begin, i))
                role, begin = v, i + 1
            i += 1
        lists.append((role, begin, i))
        for role, a, b in lists:
            if role in ("extends", "implements"):
                for t in split_types(self.span(a, b)):
                    d.supers.append(("EXTENDS" if role == "extends" else "IMPLEMENTS", t))
        body = i
        i = self.members(i + 1, full, kind, name) if i < self.n else i
        d.end, d.has_body = self.stop[min(i, self.n) - 1], body < self.n
        return i

    def method(self, first: int, i: int, owner: str, simple: str, mods: list[str], words: list[int], doc: str | None) -> int:
        close = self.balanced(i, "(", ")")
        at = words[-1] if words else i
        name = self.val[at]
        begin = self.after_mods(first, at)
        returns = self.span(begin, at)
        if returns.startswith("<"):
            returns = after_angles(returns)
        ctor = returns == "" and name == simple
        if not ctor and not returns:  # a call or something unreadable
            return close
        params = self.params(i + 1, close - 1)
        j = close
        while j < self.n and not (self.kind[j] == "p" and self.val[j] in ("{", ";", "}")):
            if self.val[j] == "@":
                j = self.annotation(j)
                continue
            if self.kind[j] == "p" and self.val[j] == "=":
                break
            j += 1
        d = Decl("method", owner, "<init>" if ctor else name, doc, self.pos[first], 0, modifiers=tuple(mods), returns="" if ctor else returns, params=params)
        if j < self.n and self.val[j] == "{" and "default" in (self.val[k] for k in range(close, j)):  # an annotation's default array
            j = self.balanced(j, "{", "}")
        if j < self.n and self.val[j] == "{":
            end = self.balanced(j, "{", "}")
            d.has_body = True
            d.calls = self.calls(j, end, params)
        elif j < self.n and self.val[j] == "}":
            end = j
        else:
            end = min(j + 1, self.n)
        d.end = self.stop[end - 1]
        self.decls.append(d)
        return end

    def after_mods(self, i: int, stop: int) -> int:
        while i < stop:
            if not self.code(i) or self.kind[i] == "word" and self.val[i] in MODIFIERS or self.val[i] == "-":
                i += 1
            elif self.val[i] == "@":
                i = self.annotation(i)
            else:
                break
        return i

    def params(self, i: int, stop: int) -> list[tuple[str, str]]:
        parts, depth, begin = [], 0, i
        for k in range(i, stop):
            v = self.val[k]
            if self.kind[k] == "p":
                if v in "<([{":
                    depth += 1
                elif v in ">)]}":
                    depth -= 1
                elif v == "," and depth == 0:
                    parts.append((begin, k))
                    begin = k + 1
        parts.append((begin, stop))
        out = []
        for a, b in parts:
            a = self.after_mods(a, b)
            words = [k for k in range(a, b) if self.kind[k] == "word"]
            if not words or self.val[words[-1]] == "this":
                continue
            name = words[-1]
            out.append((self.span(a, name) + self.span(name + 1, b).replace(" ", ""), self.val[name]))
        return out

    def fields(self, first: int, i: int, owner: str, mods: list[str], words: list[int], doc: str | None) -> int:
        names, val, n = [words[-1]] if words else [], self.val, self.n
        begin = self.after_mods(first, i)
        depth, expect = 0, False
        while i < n:
            v = val[i]
            if self.kind[i] == "p":
                if v in ("(", "{", "["):
                    i = self.balanced(i, v, {"(": ")", "{": "}", "[": "]"}[v])
                    continue
                if v == ";":
                    break
                if v == "}":
                    i -= 1
                    break
                if v == "<":
                    depth += 1
                elif v == ">":
                    depth -= 1
                elif v == ",":
                    expect = depth <= 0
                    i += 1
                    continue
            if expect and self.kind[i] == "word":
                j = self.next_code(i + 1)
                if j < n and val[j] in (",", ";", "=", "["):
                    names.append(i)
            expect = False
            i += 1
        end = min(i + 1, n)
        if words and len(words) > 1:
            t = self.span(begin, words[-1])
            for k in names:
                self.decls.append(Decl("field", owner, val[k], doc, self.pos[first], self.stop[end - 1], modifiers=tuple(mods), returns=t))
        return end

    def local_types(self, i: int, stop: int) -> dict[str, str]:
        """Simple types of the variables that a body declares."""
        out: dict[str, str] = {}
        val, kind = self.val, self.kind
        for k in range(i + 1, stop - 1):
            if kind[k] == "word" and val[k + 1] in ("=", ";", ":", ",") and val[k] not in _NO_CALL:
                j = k - 1
                while j > i and val[j] in ("]", "["):
                    j -= 1
                if val[j] == ">":
                    depth = 0
                    while j > i:
                        depth += (val[j] == ">") - (val[j] == "<")
                        j -= 1
                        if not depth:
                            break
                if kind[j] == "word" and val[j] not in _NO_TYPE and (val[j][:1].isupper() or val[j] in _PRIMITIVES):
                    out.setdefault(val[k], val[j])
        return out

    def calls(self, i: int, stop: int, params: list[tuple[str, str]] = ()) -> list[Call]:
        """Every call in a body, with what the body tells about its scope and arguments."""
        out = []
        val, kind = self.val, self.kind
        known: dict[str, str] | None = None
        for k in range(i, stop - 1):
            if kind[k] == "word" and val[k + 1] == "(" and val[k] not in _NO_CALL and not (k and val[k - 1] == "new"):
                if known is None:
                    known = self.local_types(i, stop) | {n: simple_type(t) for t, n in params}
                depth, args, any_, cuts, end = 0, 0, False, [k + 2], stop
                for j in range(k + 1, stop):
                    v = val[j]
                    if kind[j] == "p" and v in "([{":
                        depth += 1
                    elif kind[j] == "p" and v in ")]}":
                        depth -= 1
                        if depth == 0:
                            end = j
                            break
                    elif depth == 1 and v == ",":
                        args += 1
                        cuts.append(j + 1)
                    else:
                        any_ = True
                    if depth > 1:
                        any_ = True
                n = args + 1 if any_ else 0
                scope: str | None = ""
                if k >= 2 and val[k - 1] == ".":
                    scope = val[k - 2] if kind[k - 2] == "word" and not (k >= 3 and val[k - 3] == ".") else None
                    scope = "" if scope == "this" else scope
                parts = [self.type_of(a, b, known) for a, b in zip(cuts, [c - 1 for c in cuts[1:]] + [end])] if n else []
                out.append(Call(val[k], n, self.pos[k], scope, known.get(scope or "", ""), parts[:n]))
        return out

    def type_of(self, a: int, b: int, known: dict[str, str]) -> str:
        """The simple type of an argument, '' if it can't be told."""
        code = [k for k in range(a, b) if self.code(k)]
        if len(code) >= 2 and self.val[code[0]] == "new" and self.kind[code[1]] == "word":
            return self.val[code[1]]
        if len(code) != 1:
            return ""
        v, k = self.val[code[0]], self.kind[code[0]]
        if k == "str":
            return "char" if v[0] == "'" else "String"
        if k == "num":
            return "long" if v[-1] in "lL" and not v.lower().startswith("0x") or v[-1] in "lL" else "float" if v[-1] in "fF" and not v.lower().startswith("0x") else "double" if "." in v else "int"
        if k != "word":
            return ""
        return "boolean" if v in ("true", "false") else "" if v in ("null", "this") else known.get(v) or f"?{v}"


# Primitive types, and words that look like a type before a name without being one.
_PRIMITIVES = frozenset("byte short int long float double boolean char var".split())
_NO_TYPE = frozenset("return throw else case new assert package import instanceof".split())
# Words that may stand before a bracket without being a call.
_NO_CALL = frozenset("if for while switch catch synchronized try return throw assert super this new else do case".split())


def split_types(s: str) -> list[str]:
    """Split ``A<B, C>, D`` at its outer commas; type arguments go away."""
    out, depth, cur = [], 0, ""
    for ch in s:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        elif depth == 0:
            cur += ch
    return [x for x in [*out, cur.strip()] if x]


def after_angles(s: str) -> str:
    depth = 0
    for i, ch in enumerate(s):
        depth += (ch == "<") - (ch == ">")
        if depth == 0:
            return s[i + 1 :].strip()
    return ""


def parse(text: str | None, want_calls: bool = True) -> Unit:
    """The declarations of one file; null or empty text has none."""
    if not text:
        return Unit("", [], [])
    r = _Reader(text)
    if not want_calls:
        r.calls = lambda *a: []
    package, imports, i, doc = "", [], 0, None
    try:
        while i < r.n:
            v = r.val[i]
            if r.kind[i] == "doc":
                doc, i = v, i + 1
            elif r.kind[i] == "com":
                doc, i = None, i + 1
            elif v in ("package", "import") and r.kind[i] == "word":
                j = i
                while j < r.n and r.val[j] != ";":
                    j += 1
                words = r.span(i + 1, j)
                if v == "package":
                    package = words.replace(" ", "")
                else:
                    imports.append(words)
                doc, i = None, j + 1
            elif v == "@" and not (i + 1 < r.n and r.val[i + 1] == "interface"):
                i = r.annotation(i)
            elif r.kind[i] == "word" or v == "@":
                i = max(r.member(i, package, "", "", doc), i + 1)
                doc = None
            else:
                doc, i = None, i + 1
    except RecursionError:
        return Unit(package, imports, r.decls, "nesting too deep")
    for d in r.decls:
        d.line_start, d.line_end = _line(r.line, d.start), _line(r.line, max(d.start, d.end - 1))
    return Unit(package, imports, r.decls)


def _line(starts: list[int], at: int) -> int:
    import bisect

    return bisect.bisect_right(starts, at)


def candidates(unit: Unit, name: str, inside: str = "") -> list[str]:
    """Qualified names a type name may stand for, most likely first.

    An explicit import decides alone. Else: as written if it looks qualified,
    a type nested in ``inside`` or around it, the same package, the packages
    imported as a whole. Which of them exists is for a join to say.
    """
    head, _, tail = name.partition(".")
    for imp in unit.imports:
        if imp.rpartition(".")[2] == head and not imp.startswith("static "):
            return [imp + (f".{tail}" if tail else "")]
    if "." in name and head[:1].islower():
        return [name]
    out = []
    while inside and inside != unit.package:
        out.append(f"{inside}.{name}")
        inside = inside.rpartition(".")[0]
    out.append(f"{unit.package}.{name}" if unit.package else name)
    out += [f"{imp[:-2]}.{name}" for imp in unit.imports if imp.endswith(".*") and not imp.startswith("static ")]
    return out


def signature(d: Decl) -> str:
    """``Type name(Type a, Type b)``; a constructor has the type's simple name and no return type."""
    args = ", ".join(f"{t} {n}" for t, n in d.params)
    return f"{d.owner.rpartition('.')[2]}({args})" if d.name == "<init>" else f"{d.returns} {d.name}({args})"
