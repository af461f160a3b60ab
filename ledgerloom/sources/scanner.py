"""Tokens of languages with brackets, and what stands where: bodies, members, calls with the definition around them.

A file is cut into names, strings and marks; comments, regular expressions and the inside of strings are no code, what a
template string puts in is. Brackets are paired once. A definition is a range of tokens, so the definition around a call
comes from one walk over the tokens with a stack of open ranges. Brackets that have no partner end with the file."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

SCRIPT = (".ts", ".mts", ".cts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
LANGUAGES = (*SCRIPT, ".java", ".go", ".rs", ".cs")

_OPEN, _CLOSE = "([{", ")]}"
_STRINGS = {"script": r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", ".java": r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?', ".go": r"`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", ".rs": r"b?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]+?|[^'\\\n])'", ".cs": r'"""+.*?"""+|\$?@\$?"(?:""|[^"])*"?|\$?"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'}
_TOKEN = {k: re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{s})|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|::|->|\?\.|\.\.\.|==+|!=+|<=|>=|.)", re.S) for k, s in _STRINGS.items()}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
#: Words after which an expression begins, and words that are followed by a bracket without being called.
_BEFORE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await"}
_COMMON = "if for while switch return else do case try catch finally throw new this super break continue default"
_KEYWORDS = {
    "script": {*_COMMON.split(), *"function typeof await import delete void in of with yield instanceof var const let class async export extends".split()},
    ".java": {*_COMMON.split(), *"class interface enum record synchronized instanceof import package extends implements throws assert yield var void".split()},
    ".cs": {*_COMMON.split(), *"class interface enum record struct lock using fixed foreach when where sizeof typeof base checked unchecked stackalloc await is as in out ref namespace void".split()},
    ".go": {*"if for switch return else case break continue default func go defer select range type interface struct map chan var const package import fallthrough goto".split()},
    ".rs": {*"if for while return else match fn let loop move unsafe impl where use mod pub struct enum trait in as mut ref const static type dyn async await crate self Self super".split()},
}
_MODIFIERS = {"public", "private", "protected", "static", "async", "override", "readonly", "abstract", "get", "set", "declare", "accessor", "final", "native", "synchronized", "default", "virtual", "sealed", "internal", "extern", "partial", "unsafe", "new", "*", "#"}


class Code:
    def __init__(self, source: str, extension: str):
        self.script = extension in SCRIPT
        self.extension = extension
        self.keywords = _KEYWORDS["script" if self.script else extension]
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self._starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self._cut(source)
        n = len(self.text)
        self.close, self.open = {}, {}
        self.around = [-1] * n
        stack: list[int] = []
        for i in range(n):
            if self.kind[i] == "mark" and self.text[i] in _CLOSE:
                if stack and _OPEN.index(self.text[stack[-1]]) == _CLOSE.index(self.text[i]):
                    self.close[stack[-1]] = i
                    self.open[i] = stack.pop()
            self.around[i] = stack[-1] if stack else -1
            if self.kind[i] == "mark" and self.text[i] in _OPEN:
                stack.append(i)
        self.close |= dict.fromkeys(stack, n)
        self.generics = self._paired_generics()
        self.members = {i for i in self.close if self.text[i] == "{" and self._has_members(i)}

    def _cut(self, source: str) -> None:
        token, templates, depth, i = _TOKEN["script" if self.script else self.extension], [], 0, 0

        def add(kind: str, text: str, at: int) -> None:
            self.kind.append(kind)
            self.text.append(text)
            self.at.append(at)

        while i < len(source):
            c = source[i]
            if self.script and (c == "`" or (c == "}" and templates and templates[-1][0] == depth)):
                if c == "`":
                    add("string", "", i)
                    begun = (depth, len(self.text) - 1, i)
                else:
                    begun = templates.pop()
                end = _TEMPLATE.match(source, i + 1).end()
                if source.startswith("${", end):
                    templates.append(begun)
                    add("mark", ",", end)  # what is put in stands by itself
                    i = end + 2
                else:
                    self.text[begun[1]] = source[begun[2] : end + 1]
                    i = end + 1
                continue
            if self.script and c == "/" and not source.startswith(("//", "/*"), i) and not self._ends_value() and (not self.text or self.text[-1] != "<") and (m := _REGEX.match(source, i)):
                add("regex", m[0], i)
                i = m.end()
                continue
            m = token.match(source, i)
            kind, text, i = m.lastgroup if m.lastgroup != "hash" else "string", m[0], m.end()
            if kind != "skip":
                depth += (text == "{") - (text == "}") if kind == "mark" else 0
                add(kind, text, m.start())

    def _ends_value(self) -> bool:
        if not self.text:
            return False
        return self.text[-1] not in _BEFORE if self.kind[-1] == "name" else self.kind[-1] != "mark" or self.text[-1] in _CLOSE

    def line(self, i: int) -> int:
        return bisect_right(self._starts, self.at[min(i, len(self.at) - 1)])

    def is_(self, i: int, *texts: str) -> bool:
        """Whether token i is one of these words or marks."""
        return 0 <= i < len(self.text) and self.kind[i] in ("name", "mark") and self.text[i] in texts

    def name(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) and self.kind[i] == "name" else ""

    def string(self, i: int) -> str | None:
        """A string's inside."""
        if 0 <= i < len(self.text) and self.kind[i] == "string":
            return re.sub(r"^[\"'`]|[\"'`]$", "", self.text[i])
        return None

    def past(self, i: int) -> int:
        """The token after a bracket's partner, or after token i."""
        return self.close.get(i, i) + 1

    def past_generics(self, i: int) -> int:
        """The token after <...> at i, or i if there is none."""
        return self.generics[i] + 1 if i in self.generics else i

    def _paired_generics(self) -> dict[int, int]:
        """< and the > that ends it, however far; paired once. Marks that no type has end what is open, as do brackets around it."""
        out, stack = {}, []
        for i in range(self.text.index("<") if "<" in self.text else len(self.text), len(self.text)):
            if self.is_(i, "<"):
                stack.append(i)
            elif self.is_(i, ">"):
                if stack and self.around[stack[-1]] == self.around[i]:
                    out[stack.pop()] = i
            elif self.kind[i] == "mark" and self.text[i] not in (",", ".", "[", "]", "|", "&", "?", "::", "{", "}", ":", "(", ")", "=>", "'"):
                stack.clear()
            elif i in self.open or self.is_(i, *_CLOSE):
                while stack and stack[-1] > self.open.get(i, -1):
                    stack.pop()
        return out

    def new_line(self, i: int) -> bool:
        return i > 0 and self.line(i) > self.line(i - 1)

    def _has_members(self, i: int) -> bool:
        """Whether { at i opens a class, an interface or, in scripts, an object."""
        if self.script and self.is_(i - 1, "=", "(", ",", "[", ":", "return", "?", "&", "|", "...") and not (self.is_(i - 1, ":") and self.is_(self.around[i], "{") and self.around[i] not in self.close):
            return True
        if self.extension == ".java" and self.is_(i - 1, ")"):  # new Type(...) { members }
            j = self.open.get(i - 1, 0) - 1
            while j > 0 and (self.name(j) or self.is_(j, ".", "<", ">")) and not self.is_(j, "new"):
                j -= 1
            if self.is_(j, "new"):
                return True
        j = i - 1
        while j >= 0 and not self.is_(j, ";", "{", "}", "=>"):
            j = self.open[j] if j in self.open else j
            if self.is_(j, "class", "interface", "enum", "record", "struct") and not self.is_(j - 1, "."):
                return self.extension not in (".go", ".rs") or self.is_(j, "interface")
            j -= 1
        return False

    def at_member(self, i: int) -> bool:
        """Whether name i can be a member's name: it stands in a class by itself or after modifiers."""
        if self.around[i] not in self.members:
            return False
        if self.is_(i - 1, "{", "}", ";", *_MODIFIERS) or (self.is_(i - 1, ",") and self.script):
            return True
        return self.script and (self.new_line(i) or self.is_(i - 1, ")")) and not self.is_(i - 1, "=", "=>", "(", ".", "?", ":", "&", "|", "+", "-")

    def expression_end(self, i: int) -> int:
        """The last token of an expression that begins at i: before a comma, semicolon, closing bracket, or a line that
        can't go on with it."""
        j, here = i, self.around[i] if i < len(self.text) else -1
        while j < len(self.text):
            if j > i and (self.is_(j, ";", ",") or self.close.get(here) == j):
                return j - 1
            if j > i and self.new_line(j) and (self.kind[j] in ("name", "string") or self.is_(j, "@", "{", "#")) and not self.is_(j, "in", "of", "instanceof", "as", "satisfies") and (self.kind[j - 1] != "mark" or self.text[j - 1] in _CLOSE) and not self.is_(j - 1, *_BEFORE):
                return j - 1
            j = self.past(j)
        return len(self.text) - 1

    def body(self, i: int, stops: tuple[str, ...] = (";",)) -> int | None:
        """The { of the body that follows a parameter list's end at i; None if the definition has none."""
        typed = self.is_(i, ":")
        while i < len(self.text):
            if self.is_(i, *stops, "=", ",") or (self.script and self.is_(i, ")", "]", "}")):
                return None
            if self.is_(i, "{"):
                if not (typed and self.is_(i - 1, ":", "|", "&") or self.is_(self.past(i), "{") and self.is_(i - 1, ":")):
                    return i
            if self.script and self.is_(i, "(") and not typed:
                return None
            i = self.past(i)
        return None

    def arrow(self, i: int) -> int | None:
        """The last token of a function that begins at i, written with => or as a function expression; None for anything else."""
        j = i + 1 if self.is_(i, "async") else i
        if self.is_(j, "function"):
            j += 1 + self.is_(j + 1, "*")
            j += bool(self.name(j))
            j = self.past_generics(j)
            opened = self.body(self.past(j)) if self.is_(j, "(") else None
            return None if opened is None else self.close[opened]
        j = self.past_generics(j)
        if self.is_(j, "("):
            j = self.past(j)
            if self.is_(j, ":"):
                j += 1
                while j < len(self.text) and not self.is_(j, "=>", ";", "=", ","):
                    j = self.past(j)
        elif self.name(j):
            j += 1
        else:
            return None
        if not self.is_(j, "=>"):
            return None
        return self.close[j + 1] if self.is_(j + 1, "{") else self.expression_end(j + 1)

    def owners(self, ranges: list[tuple[int, int, int]], places: list[int]) -> Iterator[tuple[int, int]]:
        """(first token, last token, line) of definitions and ordered places -> each place with the line of the innermost one around it, 0 without one."""
        ranges, stack, k = sorted(ranges, key=lambda r: (r[0], -r[1])), [], 0
        for place in places:
            while k < len(ranges) and ranges[k][0] <= place:
                stack.append(ranges[k])
                k += 1
            while stack and stack[-1][1] < place:
                stack.pop()
            alive = next((r for r in reversed(stack) if r[1] >= place), None)
            yield place, alive[2] if alive else 0

    def statement(self, i: int) -> bool:
        """Whether a declaration may begin at i: not within an expression."""
        return not self.is_(i - 1, "=", "(", ",", "[", ":", "?", "=>", "return", "&", "|", "!", "+", "new", "...", "await", "typeof", "throw", ".")


Found = list[tuple]  # (kind, name, token, spec, orig)


def _script(c: Code) -> tuple[Found, list, set[int]]:
    out, ranges, taken = [], [], set()

    def define(name: str, token: int, first: int, last: int, said: bool = True) -> None:
        ranges.append((first, last, c.line(token)))
        if said:
            out.append(("def", name, token, None, None))

    def clause(i: int) -> Iterator[tuple[str, str, bool]]:
        """(name, alias, whether it is a type) of { a, b as c, type D } at i."""
        j = i + 1
        while j < c.close[i]:
            typed = c.is_(j, "type") and bool(c.name(j + 1)) and not c.is_(j + 1, "as")
            j += typed
            if c.name(j):
                alias = c.name(j + 2) if c.is_(j + 1, "as") else c.name(j)
                yield c.name(j), alias, typed
            while j < c.close[i] and not c.is_(j, ","):
                j += 1
            j += 1

    for i in range(len(c.text)):
        if c.kind[i] != "name":
            continue
        word = c.text[i]
        if word == "import" and not c.is_(i + 1, "(", ".") and c.statement(i):
            j = i + 1 + (c.is_(i + 1, "type") and not c.is_(i + 2, "from", "="))
            named = []
            while j < len(c.text) and c.string(j) is None and not c.is_(j, ";", "="):
                if c.is_(j, "{"):
                    named += [(alias, name) for name, alias, typed in clause(j) if not typed]
                elif c.is_(j, "*") and c.is_(j + 1, "as"):
                    named.append((c.name(j + 2), c.name(j + 2)))
                    j += 2
                elif c.name(j) and c.text[j] != "from":
                    named.append((c.text[j], c.text[j]))
                j = c.past(j)
            if (spec := c.string(j)) is not None:
                out.append(("import", None, i, spec, None))
                out += [("named", alias, i, spec, name) for alias, name in named if alias]
        elif word == "require" and c.is_(i + 1, "(") and not c.is_(i - 1, "."):
            taken.add(i)
            if (spec := c.string(i + 2)) is not None:
                out.append(("import", None, i, spec, None))
        elif word == "export" and c.statement(i) and not c.is_(i + 1, ":", "("):
            j = i + 1
            while c.is_(j, "default", "async", "abstract", "type") and not (c.is_(j, "type") and c.name(j + 1)):
                j += 1
            if c.is_(j, "{") or c.is_(j, "*"):
                if c.is_(j, "{"):
                    out += [("export", alias, i, None, None) for _, alias, _ in clause(j)]
                end = c.past(j)
                while c.is_(end, "as") or (c.name(end) and c.is_(end - 1, "as")):
                    end += 1
                if c.is_(end, "from") and (spec := c.string(end + 1)) is not None:
                    out.append(("import", None, i, spec, None))
            elif c.is_(j, "function", "class", "interface", "type", "enum"):
                j += 1 + c.is_(j + 1, "*")
                if c.name(j) and not c.is_(j, "extends", "implements"):
                    out.append(("export", c.name(j), i, None, None))
        elif word == "function" and c.statement(i - c.is_(i - 1, "async")):
            j = i + 1 + c.is_(i + 1, "*")
            params = c.past_generics(j + 1)
            if c.name(j) and c.is_(params, "("):
                taken.add(j)
                if (opened := c.body(c.past(params))) is not None:
                    define(c.name(j), i, i, c.close[opened])
        elif word == "function":
            taken.add(i + 1 + c.is_(i + 1, "*"))
        elif word == "class" and c.name(i + 1) and not c.is_(i + 1, "extends", "implements") and c.statement(i) and not c.is_(i - 1, "abstract"):
            out.append(("export", c.name(i + 1), i, None, None))
        elif word in ("const", "let", "var") and not c.is_(i - 1, "."):
            j = i + 1
            while c.name(j):
                name, start = c.name(j), j
                j += 1
                if c.is_(j, ":"):
                    while j < len(c.text) and not c.is_(j, "=", ";", ",") and not (c.new_line(j) and c.name(j)):
                        j = c.past(j)
                if c.is_(j, "="):
                    last = c.arrow(j + 1)
                    if last is not None:
                        define(name, start, j + 1, last)
                    j = (c.expression_end(j + 1) if last is None else last) + 1
                if not c.is_(j, ","):
                    break
                j += 1
        elif word not in c.keywords and c.at_member(i) or (c.around[i] in c.members and c.is_(i + 1, "(") and c.is_(i - 1, "{", "}", ";", ",", *_MODIFIERS)):
            params = c.past_generics(i + 1 + c.is_(i + 1, "?", "!"))
            if c.is_(params, "("):
                opened = c.body(c.past(params))
                if opened is not None:
                    taken.add(i)
                    define(word, i, i, c.close[opened], word != "constructor")
                elif not c.is_(i - 1, ","):
                    taken.add(i)
            elif c.is_(i + 1, "=", ":", "?", "!") and not c.is_(c.around[i] - 1, "=", "(", ",", ":", "[", "return", "?"):
                j = i + 1 + c.is_(i + 1, "?", "!")
                if c.is_(j, ":"):
                    while j < len(c.text) and not c.is_(j, "=", ";", ",", "}"):
                        j = c.past(j)
                if c.is_(j, "=") and not c.is_(j + 1, "function") and not (c.is_(j + 1, "async") and c.is_(j + 2, "function")):
                    last = c.arrow(j + 1)
                    if last is not None:
                        define(word, i, j + 1, last)
    return out, ranges, taken


def _typed(c: Code) -> tuple[Found, list, set[int]]:
    """Java and C#."""
    out, ranges, taken = [], [], set()
    java = c.extension == ".java"
    for i in range(len(c.text)):
        word = c.name(i)
        if not word:
            continue
        if word == ("import" if java else "using") and c.around[i] in (-1, *([] if java else [c.around[i]] if c.is_(c.around[i], "{") and c.around[i] not in c.members else [])) and not c.is_(i + 1, "("):
            j = i + 1 + c.is_(i + 1, "static")
            if not java and c.is_(j + 1, "="):
                j += 2
            parts = []
            while c.name(j):
                parts.append(c.name(j))
                j += 1
                if not (c.is_(j, ".", "::") and c.name(j + 1)):
                    break
                j += 1
            ended = c.is_(j, ";") or (c.is_(j, ".") and c.is_(j + 1, "*"))
            if parts and ended:
                spec = ".".join(parts)
                out.append(("import", None, i, spec, None))
                if java and parts[-1][:1].isupper():
                    out.append(("named", parts[-1], i, spec, parts[-1]))
        elif word in (("class", "interface", "enum") if java else ("class", "interface", "record")) and c.name(i + 1) and not c.is_(i - 1, ".") and not (not java and word == "record" and not c.statement(i)):
            j = i + 1 + (word == "record" and c.is_(i + 1, "struct", "class"))
            if not (word == "class" and not java and c.is_(i - 1, "record")):
                out.append(("export", c.name(j), i, None, None))
                taken.add(j)
        elif c.around[i] in c.members and word not in c.keywords:
            params = c.past_generics(i + 1)
            if not c.is_(params, "(") or c.is_(i - 1, "@", "=", ".", ",", "(", "=>", "return", "new", "?", ":", "&", "|") and not c.is_(i - 1, "new"):
                continue
            before = c.is_(i - 1, "{", "}", ";", ")", "]", ">", "?", *_MODIFIERS) or bool(c.name(i - 1))
            after = c.past(params)
            if not before or c.is_(after, ".", ","):
                continue
            first = i
            while first > 0 and not c.is_(first - 1, "{", "}", ";"):
                first = c.open[first - 1] if first - 1 in c.open else first - 1
            if first < c.around[i]:
                first = c.around[i] + 1
            j = after
            while j < len(c.text) and not c.is_(j, "{", ";", "=>"):
                j = c.past(j)
            last = c.close[j] if c.is_(j, "{") else c.expression_end(j + 1) if c.is_(j, "=>") else j
            taken.add(i)
            out += [("def", word, first, None, None), ("export", word, first, None, None)]
            ranges.append((first, last, c.line(first)))
            out += _mappings(c, first, i, java)
    return out, ranges, taken


# How mappings of methods to routes are called.
_SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "*"}
_ASPNET = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "Route": "*"}
_NEST = {"Get", "Post", "Put", "Patch", "Delete", "Head", "Options"}
_VERBS = {"get", "post", "put", "patch", "delete", "head", "options", "all"}
_SERVERS = {"app", "router", "server", "api", "fastify"}


def _mappings(c: Code, first: int, name: int, java: bool) -> Iterator[tuple]:
    """Routes of the annotations between a method's first token and its name."""
    kinds, framework = (_SPRING, "spring") if java else (_ASPNET, "aspnet")
    for j in range(first, name):
        if c.name(j) in kinds and c.is_(j - 1, *("@",) if java else ("[", ",")):
            said = next((c.string(k) for k in range(j + 2, c.close[j + 1]) if c.kind[k] == "string"), "") if c.is_(j + 1, "(") else ""
            yield "route", kinds[c.name(j)], j, said, framework


def _go(c: Code) -> tuple[Found, list, set[int]]:
    out, ranges, taken = [], [], set()
    for i in range(len(c.text)):
        if c.is_(i, "import") and c.around[i] == -1:
            grouped = c.is_(i + 1, "(")
            for j in range(i + 1, c.close[i + 1] if grouped else i + 3):
                if (spec := c.string(j)) is not None:
                    out += [("import", None, j, spec, None), ("named", spec.split("/")[-1], j, spec, spec.split("/")[-1])]
        elif c.is_(i, "func") and c.around[i] == -1:
            j = c.past(i + 1) if c.is_(i + 1, "(") else i + 1
            params = j + 1
            if c.is_(params, "["):
                params = c.past(params)
            if c.name(j) and c.is_(params, "("):
                opened = next((k for k in _along(c, c.past(params)) if c.is_(k, "{")), None)
                last = c.close[opened] if opened is not None else c.past(params)
                taken.add(j)
                out.append(("def", c.name(j), i, None, None))
                if c.name(j)[0].isupper() and c.name(j)[0].isascii():
                    out.append(("export", c.name(j), i, None, None))
                ranges.append((i, last, c.line(i)))
        elif c.is_(i, "type"):
            places = [i + 1] if not c.is_(i + 1, "(") else [j for j in _along(c, i + 2) if j < c.close[i + 1] and c.name(j) and (c.new_line(j) or j == i + 2)]
            out += [("export", c.name(j), j, None, None) for j in places if c.name(j)[:1].isascii() and c.name(j)[:1].isupper()]
        elif c.name(i) and c.around[i] in c.members and c.is_(i + 1, "("):
            taken.add(i)  # a method of an interface
    return out, ranges, taken


def _along(c: Code, i: int) -> Iterator[int]:
    """Tokens from i on at its depth; what stands in brackets is left out, and a struct's or interface's block with it."""
    while i < len(c.text):
        if not (c.is_(i, "{") and c.is_(i - 1, "struct", "interface")):
            yield i
        i = c.past(i)


def _rust(c: Code) -> tuple[Found, list, set[int]]:
    out, ranges, taken = [], [], set()
    skip = -1
    for i in range(len(c.text)):
        if i <= skip:
            taken.add(i)
            continue
        if c.is_(i, "!") and c.name(i - 1) and (i + 1) in c.close or (c.is_(i, "#") and c.is_(i + 1, "[", "!")):  # macros and attributes
            skip = c.close.get(i + 1 + c.is_(i + 1, "!"), i)
        elif c.is_(i, "use") and c.statement(i):
            parts, j = [], i + 1
            while j < len(c.text) and not c.is_(j, ";"):
                if c.name(j) and not c.is_(j - 1, "as") and not c.is_(j, "as"):
                    parts.append(c.name(j))
                elif c.is_(j, "{", "*"):
                    parts.append("")
                j = c.past(j)
            if len(parts) >= 2:
                path = "/".join(parts[:-1])
                path = "src" + path[5:] if path == "crate" or path.startswith("crate/") else path
                out.append(("import", None, i, path, None))
                if parts[-1]:
                    out.append(("named", parts[-1], i, path, parts[-1]))
        elif c.is_(i, "fn") and c.name(i + 1):
            j = c.past_generics(i + 2)
            taken.add(i + 1)
            opened = next((k for k in _along(c, c.past(j)) if c.is_(k, "{", ";")), None)
            if opened is not None and c.is_(opened, "{"):
                first = i
                while c.is_(first - 1, "async", "unsafe", "const", "extern", "pub", ")") or (first and c.kind[first - 1] == "string"):
                    first = c.open.get(first - 1, first - 1)
                    if c.is_(first, "(") and not c.is_(first - 1, "pub"):
                        first = i
                        break
                out.append(("def", c.name(i + 1), first, None, None))
                if c.is_(first, "pub"):
                    out.append(("export", c.name(i + 1), first, None, None))
                ranges.append((first, c.close[opened], c.line(first)))
        elif c.is_(i, "struct", "enum", "trait") and c.name(i + 1):
            out.append(("export", c.name(i + 1), i, None, None))
            taken.add(i + 1)
        elif c.name(i) and c.is_(i + 1, "(") and (c.is_(c.past(i + 1), "=>", "=", "|") or c.is_(i, "Fn", "FnMut", "FnOnce", "pub") or c.is_(i - 1, "let")):
            taken.add(i)  # a pattern, or a type
    for opened in c.close:
        if c.is_(opened, "{") and c.name(opened - 1) and c.is_(opened - 2, "enum"):
            taken |= {k for k in range(opened, min(c.close[opened], len(c.text))) if c.around[k] == opened}
    return out, ranges, taken


def _calls(c: Code, taken: set[int]) -> Iterator[tuple[int, str]]:
    """(token, name) of calls; a name with a full stop is what a call is made through."""
    for i in range(len(c.text) - 1):
        if c.kind[i] != "name" or i in taken or not (c.is_(i + 1, "(") or (c.is_(i + 1, "<", "::") and c.extension not in (".go",) and c.is_(c.past_generics(i + 1 + c.is_(i + 1, "::")), "("))):
            continue
        word, dotted = c.text[i], c.is_(i - 1, ".", "?.")
        if not dotted and (word in c.keywords or c.is_(i - 1, "new", "@" if c.extension == ".java" else "new")):
            continue
        start = i - 2 if dotted else i
        holder = c.name(start) if dotted and not c.is_(start - 1, ".", "?.", "::") else ""
        if c.script or c.extension == ".go":
            if dotted and holder and holder not in ("this", "super") and not c.is_(start - 1, "new"):
                yield i, holder + "."
            elif not dotted:
                yield i, word
            continue
        held = c.around[i]
        if c.extension == ".cs" and c.is_(held, "[") and (c.is_(held - 1, "{", "}", ";", "(", ",") or (c.is_(held - 1, "]") and c.new_line(held))):
            continue  # an attribute
        chain = i
        while c.is_(chain - 1, ".", "::", "?."):
            chain = c.open.get(chain - 2, chain - 2)
        if c.is_(chain - 1, "new") and c.extension in (".java", ".cs") and all(c.name(k) or c.is_(k, ".") for k in range(chain, i)):
            continue
        if holder and holder[:1].isupper() and c.extension in (".java", ".cs"):
            yield i, holder + "."
        yield i, word


def _script_routes(c: Code) -> Iterator[tuple]:
    for i in range(len(c.text) - 3):
        if c.name(i) in _SERVERS and c.is_(i + 1, ".") and c.name(i + 2) in _VERBS and c.is_(i + 3, "(") and not c.is_(i - 1, ".", "?.") and (path := c.string(i + 4)) is not None:
            yield "route", c.name(i + 2).upper(), i, path, "express-like"
        elif c.is_(i, "@") and c.name(i + 1) in _NEST and c.is_(i + 2, "("):
            yield "route", c.name(i + 1).upper(), i, c.string(i + 3) or "", "nest"


def facts(source: str, extension: str) -> Iterator[tuple]:
    """(kind, name, line, owner, spec, orig) of a file; definitions once by name, the first line of each."""
    c = Code(source, extension)
    if not c.text:
        return
    found, ranges, taken = {".go": _go, ".rs": _rust}.get(extension, _script if c.script else _typed)(c)
    if c.script:
        found += _script_routes(c)
    defs: set[str] = set()
    exported: set[str] = set()
    for kind, name, token, spec, orig in sorted(found, key=lambda f: f[2]):
        seen = defs if kind == "def" else exported if kind == "export" else None
        if seen is None or name not in seen:
            if seen is not None:
                seen.add(name)
            yield kind, name, c.line(token), None, spec, orig
    calls = list(_calls(c, taken))
    for (i, name), (_, owner) in zip(calls, c.owners(ranges, [i for i, _ in calls]), strict=True):
        yield "call", name, c.line(i), owner, None, None
