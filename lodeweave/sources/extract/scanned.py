"""Go, Ruby, TypeScript and JavaScript by scanning: strings and comments are blanked, then brackets are matched.

Regular expressions are told from division by what stands before them, as
scripts and Ruby allow either; what stands in a template's ``${}`` is code; a
heredoc's lines are a string. This isn't a grammar: calls with type arguments
are seen only where these follow the name without a blank.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from lodeweave.sources.extract import Call, Extract, Symbol, last_segment, split_as

_OPEN, _CLOSE = "([{", ")]}"
_NAME = r"[A-Za-z_$][\w$]*"


_BLANK = re.compile(r"[^\n]")
_BEFORE_REGEX = {"script": re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|delete|void|instanceof|new|do|else|yield|await))$"), "ruby": re.compile(r"(?:^|[(,=:\[!&|?{};~\n]|\b(?:if|unless|when|and|or|not|while|until|return|elsif|then))$")}
_HEREDOC = re.compile(r"(?:(?<=[\s(,=])|^)<<([~-]?)([\"'`]?)([A-Z_]\w*)\2")
_LITERAL = re.compile(r"%[wWiIqQrx]?([\[({<|!])")
_PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">"}


def _blank(text: str) -> str:
    return _BLANK.sub(" ", text)


def without_heredocs(source: str) -> str:
    """Return Ruby source, as long as before, in which heredocs are strings and their lines blank."""
    out, waiting = [], []
    for line in source.split("\n"):
        if waiting:
            loose, tag = waiting[0]
            if (line.strip() if loose else line.rstrip("\r")) == tag:
                waiting.pop(0)
            out.append(" " * len(line))
            continue
        head = line.partition(" #")[0] if not line.lstrip().startswith("#") else ""
        found = list(_HEREDOC.finditer(head))
        waiting += [(bool(m[1]), m[3]) for m in found]
        for m in found:
            line = line[: m.start()] + '"' + " " * (m.end() - m.start() - 2) + '"' + line[m.end() :]
        out.append(line)
    return "\n".join(out)


def _regex_end(source: str, at: int) -> int:
    """Return the place after the slash that ends a regular expression; 0 if none does on its line."""
    inside = False
    while at < len(source) and source[at] != "\n":
        if source[at] == "\\":
            at += 1
        elif source[at] == "[":
            inside = True
        elif source[at] == "]":
            inside = False
        elif source[at] == "/" and not inside:
            return at + 1
        at += 1
    return 0


def blanked(source: str, line_comment: str, block: bool, quotes: str, flavour: str = "") -> str:
    """Return the source, as long as before, with comments and the insides of strings as blanks."""
    stops = [re.escape(q) for q in quotes] + [re.escape(line_comment)] + ([r"/\*"] if block else []) + (["/"] if flavour else []) + ([_LITERAL.pattern.replace("(", "(?:", 1)] if flavour == "ruby" else [])
    start = re.compile("|".join(stops))
    out, at = [], 0
    while m := start.search(source, at):
        out.append(source[at : m.start()])
        token = m[0]
        if token == line_comment:
            end = source.find("\n", m.end())
            end = len(source) if end < 0 else end
            out.append(_blank(source[m.start() : end]))
        elif token == "/*":
            end = source.find("*/", m.end())
            end = len(source) if end < 0 else end + 2
            out.append(_blank(source[m.start() : end]))
        elif token == "/":
            before = "".join(out)[-40:].rstrip(" \t")
            end = _regex_end(source, m.end()) if _BEFORE_REGEX[flavour].search(before) else 0
            out.append("/" + _blank(source[m.end() : end - 1]) + "/" if end else "/")
            end = end or m.end()
        elif token[0] == "%":
            before = "".join(out)[-1:]
            close, depth, end = _PAIRS.get(token[-1], token[-1]), 1, m.end()
            while depth and end < len(source):
                depth += (source[end] == token[-1] and token[-1] in _PAIRS) - (source[end] == close)
                end += 1
            if len(token) == 2 and (before.isalnum() or before in "_)]} "):  # a remainder
                end = m.end()
                out.append(token)
            else:
                out.append('"' + _blank(source[m.start() + 1 : end - 1]) + '"')
        elif token == "`" and flavour == "script":
            end, piece = m.end(), m.end()
            out.append(token)
            while end < len(source) and source[end] != token:
                if source.startswith("${", end):
                    out.append(_blank(source[piece:end]) + " (")
                    inner, depth = end + 2, 1
                    end = inner
                    while end < len(source) and depth:
                        depth += (source[end] == "{") - (source[end] == "}")
                        end += 1
                    out.append(blanked(source[inner : end - 1], line_comment, block, quotes, flavour) + ")" * (depth == 0))
                    piece = end
                else:
                    end += 2 if source[end] == "\\" else 1
            end = min(end, len(source))
            closed = end < len(source)
            out.append(_blank(source[piece:end]) + token * closed)
            end += closed
        else:
            end = m.end()
            while end < len(source) and source[end] != token:
                if source[end] == "\n" and token != "`":
                    break
                end += 2 if source[end] == "\\" else 1
            end = min(end, len(source))
            closed = end < len(source) and source[end] == token
            out.append(token + _blank(source[m.end() : end]) + token * closed)
            end += closed
        at = end
    out.append(source[at:])
    return "".join(out)


def closing(masked: str, at: int) -> int:
    """Return the place of the bracket that closes the one at ``at``; the end if there is none."""
    depth = 0
    for i in range(at, len(masked)):
        if masked[i] in _OPEN:
            depth += 1
        elif masked[i] in _CLOSE:
            depth -= 1
            if depth == 0:
                return i
    return len(masked)


def _opening(masked: str, at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        if masked[i] in _CLOSE:
            depth += 1
        elif masked[i] in _OPEN:
            depth -= 1
            if depth == 0:
                return i
    return 0


def _operand(masked: str, dot: int) -> int:
    """Return where the expression before a dot begins."""
    i = dot
    while True:
        while i > 0 and masked[i - 1].isspace():
            i -= 1
        while i > 0 and masked[i - 1] in _CLOSE:
            i = _opening(masked, i - 1)
        j = i
        while j > 0 and (masked[j - 1].isalnum() or masked[j - 1] in "_$@?!"):
            j -= 1
        if j == i and i > 0 and masked[i - 1] in "\"'`":  # a string
            j = masked.rfind(masked[i - 1], 0, i - 1)
            j = max(j, 0)
        i = j
        k = i
        while k > 0 and masked[k - 1].isspace():
            k -= 1
        if k > 0 and masked[k - 1] == ".":
            i = k - 1
        elif k > 1 and masked[k - 2 : k] == "::":
            i = k - 2
        else:
            return i


class Source:
    """A file's text, its blanked form, and line numbers."""

    def __init__(self, source: str, line_comment: str, block: bool, quotes: str, flavour: str = ""):
        self.text, self.masked = source, blanked(without_heredocs(source) if flavour == "ruby" else source, line_comment, block, quotes, flavour)
        self.generic = flavour == "script"
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(self, at: int) -> int:
        """Return the number of the line at a place, from 1."""
        return bisect_right(self.starts, at)

    def flat(self, a: int, b: int) -> str:
        """Return a stretch of text."""
        return self.text[a:b].strip()

    def arity(self, a: int, b: int) -> int:
        """Return the number of arguments between two brackets."""
        inner = self.masked[a + 1 : b]
        if not inner.strip():
            return 0
        depth = commas = 0
        for ch in inner.rstrip().rstrip(","):
            depth += (ch in _OPEN) - (ch in _CLOSE)
            commas += ch == "," and depth == 0
        return commas + 1

    def calls(self, a: int, b: int, keywords: frozenset[str], receivers: tuple[str, ...] | None) -> list[Call]:
        """Return the calls with brackets in a stretch; ``receivers`` None takes every qualifier as receiver."""
        out = []
        types = r"(?:<[\w\s,.\[\]|&<>?:{};$]*>)?" if self.generic else ""
        for m in re.compile(rf"({_NAME})(?:{types}|\s*)(?:\?\.)?\(").finditer(self.masked, a, b):
            name, start, end = m[1], m.start(1), m.end(1)
            before = self.masked[:start].rstrip()[-1:] if start else ""
            head, qualifier = start, ""
            if before == ".":
                dot = self.masked.rfind(".", 0, start)
                cut = dot - (dot > 0 and self.masked[dot - 1] == "?")
                head = _operand(self.masked, cut)
                qualifier = self.flat(head, cut)
            elif name in keywords:
                continue
            elif re.search(r"(?:\bfunc|\bfunction|\bnew)\s*\*?\s*$", self.masked[max(0, start - 16) : start]) and not qualifier:
                continue
            bracket = m.end() - 1
            receiver = qualifier if receivers is None or qualifier in receivers else ""
            out.append(Call(name, qualifier, receiver, self.arity(bracket, closing(self.masked, bracket)), self.line(head), self.flat(head, end)))
        return out


# --- Go ---------------------------------------------------------------------

_GO = frozenset("if for switch select return func go defer range case else var const type map chan struct interface package import".split())


def go(path: str, content: bytes) -> Extract:
    """Extract Go: functions, methods with their receiver, types, imports with their names."""
    s = Source(content.decode("utf-8", "replace"), "//", True, "\"'`")
    out = Extract()

    def imported(text: str) -> None:
        for m in re.finditer(r'(?:^|\n|;)[ \t]*(?:import[ \t]+)?(?:([\w.]+)[ \t]+)?["`]([^"`\n]+)["`]', text):
            out.imports.append(m[2])
            alias = m[1] if m[1] and m[1] not in ("_", ".", "import") else last_segment(m[2])
            if alias:
                out.aliases[alias] = m[2]

    for m in re.finditer(r"(?m)^[ \t]*import\b[ \t]*(\()?", s.masked):
        end = closing(s.masked, m.end() - 1) if m[1] else s.text.find("\n", m.end())
        imported("\n" + s.text[m.end() : end if end >= 0 else len(s.text)])
    found: list[tuple[int, Symbol]] = []
    for m in re.finditer(rf"(?m)^func\s*(\([^)]*\))?\s*({_NAME})\s*(\[[^\]\n]*\])?\s*\(", s.masked):
        last = closing(s.masked, m.end() - 1)
        brace = _body(s.masked, last + 1)
        result = s.flat(last + 1, brace if brace >= 0 else _line_end(s.masked, last))
        signature = f"func {m[2]}{s.text[m.end() - 1 : last + 1]}" + (f" {result}" if result else "")
        kind = "func"
        if m[1]:
            signature, kind = f"{s.text[m.start(1) : m.end(1)]} {signature}", "method"
        calls = s.calls(brace, closing(s.masked, brace), _GO, None) if brace >= 0 else []
        found.append((m.start(), Symbol(m[2], kind, signature, s.line(m.start()), "", calls)))
    for start, m in _go_types(s):
        value = m[2]
        kind = "interface" if value == "interface" else "struct"
        shown = value if value in ("struct", "interface") else s.flat(m.start(2), _line_end(s.masked, m.start(2)))
        found.append((start, Symbol(m[1], kind, f"type {m[1]} {shown}", s.line(start))))
    out.symbols = [x for _, x in sorted(found, key=lambda p: p[0])]
    return out


def _go_types(s: Source) -> Iterator[tuple[int, re.Match]]:
    spec = re.compile(rf"[ \t]*({_NAME})(?:\[[^\]\n]*\])?[ \t]+(struct\b|interface\b|[^=\s(][^\n]*)")
    for m in re.finditer(r"(?m)^[ \t]*type\b[ \t]*(\()?", s.masked):
        if not m[1]:
            if one := spec.match(s.masked, m.end()):
                yield one.start(1), one
            continue
        at, end = m.end(), closing(s.masked, m.end() - 1)
        while at < end:
            line = _line_end(s.masked, at)
            if one := spec.match(s.masked, at, end):
                yield one.start(1), one
                brace = s.masked.find("{", one.start(2), line)
                line = max(line, closing(s.masked, brace)) if brace >= 0 else line
                line = _line_end(s.masked, line)
            at = line + 1


def _line_end(masked: str, at: int) -> int:
    end = masked.find("\n", at)
    return len(masked) if end < 0 else end


def _body(masked: str, at: int) -> int:
    """Return where a Go function's body opens after its parameters; -1 without one."""
    i = at
    while i < len(masked):
        ch = masked[i]
        if ch == "\n":
            return -1
        if ch in "([":
            i = closing(masked, i)
        elif ch == "{":
            if re.search(r"\b(?:interface|struct)\s*$", masked[at:i]):
                i = closing(masked, i)
            else:
                return i
        i += 1
    return -1


# --- TypeScript and JavaScript ----------------------------------------------

_JS = frozenset("if for while switch return function catch typeof await new with super import constructor".split()) - {"constructor", "super", "import"}


def _js_aliases(clause: str) -> Iterator[str]:
    named = re.search(r"\{([^}]*)\}", clause)
    for part in re.sub(r"\{[^}]*\}", "", clause).split(","):
        part = part.strip()
        if part.startswith("type "):
            part = part[5:].strip()
        if part.startswith("*"):
            yield split_as(part)[1]
        elif part:
            yield part
    if named:
        for part in named[1].split(","):
            if part.strip():
                yield split_as(part.strip().removeprefix("type "))[1]


def js_import_aliases(statement: str) -> list[str]:
    """Return the names that an import statement gives: default, whole module, and named ones."""
    m = re.match(r"\s*import\s+(.*?)\s+from\s", statement, re.S)
    return list(_js_aliases(m[1])) if m else []


def _js_result(s: Source, at: int) -> tuple[str, int]:
    """Return a return type as shown and where the body may begin."""
    m = re.compile(r"\s*:\s*").match(s.masked, at)
    if not m:
        return "", at
    i = m.end()
    while i < len(s.masked) and s.masked[i] not in "{;=\n":
        i = closing(s.masked, i) + 1 if s.masked[i] in "([" else i + 1
    if i < len(s.masked) and s.masked[i] == "{" and i == m.end():  # an object type
        i = closing(s.masked, i) + 1
    return ": " + s.flat(m.end(), i), i


def script(path: str, content: bytes) -> Extract:
    """Extract TypeScript or JavaScript: functions, classes with methods, interfaces, type aliases, and constants that are functions."""
    s = Source(content.decode("utf-8", "replace"), "//", True, "\"'`", "script")
    out = Extract()
    for m in re.finditer(r"(?m)^[ \t]*import\b(?!\s*\()[^;'\"`]*?([\"'])", s.masked):
        end = s.masked.find(m[1], m.end())
        target = s.text[m.end() : end]
        out.imports.append(target)
        for alias in js_import_aliases(s.text[m.start() : m.end()]):
            out.aliases[alias] = target
        if last_segment(target):
            out.aliases.setdefault(last_segment(target), target)
    found: list[tuple[int, Symbol]] = []
    inside: list[tuple[int, int]] = []  # bodies of functions, where nothing else is looked for

    def within(at: int, spans: list[tuple[int, int]]) -> bool:
        return any(a < at < b for a, b in spans)

    def body(at: int) -> tuple[int, int]:
        m = re.compile(r"\s*\{").match(s.masked, at)
        return (m.end() - 1, closing(s.masked, m.end() - 1)) if m else (at, at)

    heads = re.compile(
        rf"\b(?P<f>function)\s*\*?\s*(?P<fn>{_NAME})\s*(?:<[^>(]*>)?\(|\b(?P<c>class)\s+(?P<cn>{_NAME})(?P<h>[^{{]*)\{{|\binterface\s+(?P<in>{_NAME})|(?m:^)\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<tn>{_NAME})\b(?=[^\n]*=)"
        rf"|\b(?:const|let|var)\s+(?P<vn>{_NAME})\s*(?::[^=\n]*)?=\s*(?P<v>async\s+)?(?P<vf>function\b\s*\*?\s*(?:{_NAME})?\s*\(|\(|{_NAME}\s*=>)"
    )
    at = 0
    while m := heads.search(s.masked, at):
        at = m.end()
        if within(m.start(), inside):
            continue
        if m["fn"]:
            last = closing(s.masked, m.end() - 1)
            result, after = _js_result(s, last + 1)
            a, b = body(after)
            found.append((m.start("f"), Symbol(m["fn"], "func", f"function {m['fn']}{s.text[m.end() - 1 : last + 1]}{result}", s.line(m.start("f")), "", s.calls(a, b, _JS, ("this",)))))
            inside.append((m.start(), b))
        elif m["cn"]:
            end = closing(s.masked, m.end() - 1)
            heritage = " ".join(s.text[m.start("h") : m.end("h")].split())
            found.append((m.start("c"), Symbol(m["cn"], "class", f"class {m['cn']}" + (f" {heritage}" if heritage else ""), s.line(m.start("c")))))
            found += _methods(s, m.end(), end)
            inside.append((m.end() - 1, end))
        elif m["in"]:
            found.append((m.start(), Symbol(m["in"], "interface", f"interface {m['in']}", s.line(m.start()))))
        elif m["tn"]:
            place = s.masked.find("type", m.start())
            found.append((place, Symbol(m["tn"], "struct", f"type {m['tn']}", s.line(place))))
        else:
            start = m.start("vf")
            if m["vf"].endswith("=>"):
                parameters, after = s.flat(start, m.end() - 2), m.end() - 2
                result = ""
            else:
                bracket = m.end() - 1
                last = closing(s.masked, bracket)
                parameters = s.text[bracket : last + 1]
                result, after = _js_result(s, last + 1)
            if not m["vf"].startswith("function"):
                arrow = re.compile(r"\s*=>\s*").match(s.masked, after)
                if not arrow:
                    continue
                after = arrow.end()
            a, b = body(after)
            if a == b:  # an expression
                b = a
                while b < len(s.masked) and s.masked[b] not in ";\n":
                    b = closing(s.masked, b) + 1 if s.masked[b] in _OPEN else b + 1
            found.append((m.start("vn"), Symbol(m["vn"], "func", f"{m['vn']} = {parameters}{result} =>", s.line(m.start("vn")), "", s.calls(m.start("vf"), b, _JS, ("this",)))))
            inside.append((m.start(), b))
    out.symbols = [x for _, x in sorted(found, key=lambda p: p[0])]
    return out


def _methods(s: Source, at: int, end: int) -> Iterator[tuple[int, Symbol]]:
    head = re.compile(rf"\s*((?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*)(\*?\s*#?{_NAME})\s*(?:<[^>(]*>)?\(")
    while at < end:
        m = head.match(s.masked, at)
        if m and m[2] not in _JS:
            last = closing(s.masked, m.end() - 1)
            result, after = _js_result(s, last + 1)
            brace = re.compile(r"\s*\{").match(s.masked, after)
            if brace:
                close = closing(s.masked, brace.end() - 1)
                name = m[2].lstrip("*# ")
                start = m.start(1) if m[1] else m.start(2)
                yield start, Symbol(name, "method", f"{name}{s.text[m.end() - 1 : last + 1]}{result}", s.line(start), "", s.calls(brace.end(), close, _JS, ("this",)))
                at = close + 1
                continue
            at = last + 1
        while at < end and s.masked[at] not in ";\n{":  # a field
            at = closing(s.masked, at) + 1 if s.masked[at] in "([" else at + 1
        at = closing(s.masked, at) + 1 if at < end and s.masked[at] == "{" else at + 1


# --- Ruby -------------------------------------------------------------------

_RB = frozenset("if unless while until case when return yield def class module end do begin rescue ensure else elsif then and or not in super raise require require_relative self nil true false puts".split()) - {"raise", "puts", "require", "require_relative", "super"}
_RB_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")
_RB_END = re.compile(r"^\s*end\b")
_RB_LINE = re.compile(r"^\s*def\s+[\w.?!=]+\s*(?:\([^)]*\))?\s*=\s")
_RB_NAME = r"[A-Za-z_]\w*[?!]?"


def ruby(path: str, content: bytes) -> Extract:
    """Extract Ruby: methods, singleton methods (named with ``self.``), classes, modules, and what is required."""
    s = Source(content.decode("utf-8", "replace"), "#", False, "\"'", "ruby")
    out = Extract()
    open_: list[tuple[str, Symbol | None]] = []
    for k, line in enumerate(s.masked.split("\n")):
        at = s.starts[k]
        text = s.text[at : at + len(line)]
        if m := re.match(r"\s*(require|require_relative)\b\s*\(?\s*([\"'])([^\"']+)\2", text):
            out.imports.append(m[3])
            if last_segment(m[3]):
                out.aliases[last_segment(m[3])] = m[3]
        in_class = any(kind == "class" for kind, _ in open_)
        current = next((x for kind, x in reversed(open_) if kind == "def"), None)
        symbol = None
        if m := re.match(r"\s*class\s+([A-Z][\w:]*)(?:\s*<\s*([\w:.]+))?", line):
            symbol = Symbol(m[1], "class", f"class {m[1]}" + (f" < {m[2]}" if m[2] else ""), k + 1)
            open_.append(("class", symbol))
        elif m := re.match(r"\s*module\s+([A-Z][\w:]*)", line):
            symbol = Symbol(m[1], "module", f"module {m[1]}", k + 1)
            open_.append(("module", symbol))
        elif m := re.match(r"\s*def\s+(self\.)?([\w]+[?!=]?|[^\s(\w]+)\s*(\([^)]*\))?", line):
            name = ("self." if m[1] else "") + m[2]
            parameters = text[m.start(3) : m.end(3)] if m[3] else ""
            symbol = Symbol(name, "method" if m[1] or in_class else "func", f"def {name}{parameters}", k + 1)
            if _RB_LINE.match(line):
                symbol.calls += _ruby_calls(s, at + m.end(), at + len(line))
            else:
                open_.append(("def", symbol))
                symbol.calls += _ruby_calls(s, at + m.end(), at + len(line))
        elif _RB_END.match(line):
            if open_:
                open_.pop()
            if current:
                current.calls += _ruby_calls(s, at, at + len(line))
            continue
        else:
            if current:
                current.calls += _ruby_calls(s, at, at + len(line))
            if _RB_OPEN.search(line) and not re.search(r"\bend\b\s*$", line):
                open_.append(("block", None))
            continue
        if symbol and current is None:
            out.symbols.append(symbol)
        if re.search(r"(?:;|\s)end\s*$", line) and open_:
            open_.pop()
    return out


def _ruby_calls(s: Source, a: int, b: int) -> list[Call]:
    found = []
    masked = s.masked
    for m in re.compile(rf"(?<![\w@$:])({_RB_NAME})").finditer(masked, a, b):
        start, end, name = m.start(1), m.end(1), m[1]
        before = masked[a:start].rstrip()
        after = masked[end:b]
        qualifier, head = "", start
        if before.endswith(".") and not before.endswith(".."):
            dot = masked.rfind(".", a, start)
            cut = dot - (masked[dot - 1] == "&")
            head = _operand(masked, cut)
            qualifier = s.flat(head, cut)
            if not qualifier:
                continue
        elif name in _RB or re.match(r"\s*(?:[-+*/|&%]?=(?!=|~)|:(?!:))", after):
            continue
        elif not after.startswith("(") and not (re.match(r"[ ]+(?:[A-Za-z_@$:\"'\d]|\[)", after) and not re.match(r"[ ]+(?:if|unless|while|until|and|or|do|then|in|rescue)\b", after) and re.search(r"(?:^|[;={(|]|\bdo|\bthen|\belse|\breturn)\s*$", before) and name[0].islower()):
            continue
        stop, arity = end, 0
        if after.startswith("("):
            close = closing(masked, end)
            stop, arity = close + 1, s.arity(end, close)
        elif not qualifier or re.match(r"[ ]+[A-Za-z_@$:\"'\d]", after):
            rest = re.match(r"[ ]+([^\n#]*?)(?:\s+(?:do|if|unless)\b.*)?$", masked[end:b])
            if rest and rest[1].strip() and re.match(r"[A-Za-z_@$:\"'\d\[]", rest[1].strip()) and not re.match(r"(?:if|unless|and|or|do|then)\b", rest[1].strip()):
                stop = end + rest.end(1)
                arity = 1 + sum(1 for i, ch in enumerate(rest[1]) if ch == "," and sum((c in _OPEN) - (c in _CLOSE) for c in rest[1][:i]) == 0)
        found.append(Call(name, qualifier, "self" if qualifier == "self" else "", arity, s.line(head), s.flat(head, stop)))
    return found


# --- Python with a syntax error ----------------------------------------------


def python_lines(source: str) -> Extract:
    """Return the functions and classes that lines of a broken Python file begin, without calls."""
    out = Extract()
    for k, line in enumerate(source.split("\n"), 1):
        if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line):
            kind = "class" if m[2] == "class" else "method" if m[1] else "func"
            out.symbols.append(Symbol(m[3], kind, line.strip().rstrip(":"), k))
    return out


EXTRACTORS = {"go": go, "typescript": script, "javascript": script, "ruby": ruby}
