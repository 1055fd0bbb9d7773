"""Definitions and calls in TypeScript and Go sources, by brackets and names: an approximation without a parser.

What stands in comments and in strings (templates included) isn't seen; regular expression literals that hold
brackets or quotes may hide what follows them.
"""

import re
from bisect import bisect_right

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_TS_FUNCTION = re.compile(r"\bfunction\s+([\w$]+)\s*(?:<[^()]*>)?\s*\(")
_TS_CLASS = re.compile(r"\bclass\s+([\w$]+)")
_TS_METHOD = re.compile(r"(?<![\w$.@])(#?[\w$]+)\s*(?:<[^(){}]*>)?\s*\(")
_GO_FUNCTION = re.compile(r"^[ \t]*func\s*(?:(\([^)]*\))\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*\(", re.M)
_CALL = re.compile(r"(?:[\w$]+\s*(?:\?\.|\.)\s*)*([\w$]+)\s*(?:<[^<>(){};]*>)?\s*\(")
#: Words before a bracket that call nothing.
_KEYWORDS = {"typescript": set("if for while switch catch return typeof function await super new import".split()), "go": set("if for switch select return func defer go".split())}


def blanked(code: str) -> str:
    """The code with comments and strings as blanks; places and lines stay."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


class _Brackets:
    def __init__(self, text: str):
        self.close, self.at, self.owner, stack = {}, [-1], [-1], []
        for m in re.finditer(r"[(){}]", text):
            i, c = m.start(), m[0]
            if c in "({":
                stack.append(i)
            else:
                want = "(" if c == ")" else "{"
                while stack and text[stack[-1]] != want:
                    stack.pop()
                if stack:
                    self.close[stack.pop()] = i
            self.at.append(i)
            self.owner.append(stack[-1] if stack else -1)

    def around(self, i: int) -> int:
        """Place of the innermost bracket that is open before place i; -1 if there is none."""
        return self.owner[bisect_right(self.at, i - 1) - 1]


def _body(text: str, b: _Brackets, after: int, stop: str) -> int:
    """Place of the brace that opens a body, searched up to one of the characters of stop; -1 if there is none."""
    for m in re.compile(r"[{" + re.escape(stop) + "]").finditer(text, after):
        if m[0] != "{":
            return -1
        if re.search(r"\b(?:interface|struct)\s*$", text[max(0, m.start() - 12) : m.start()]):
            after = b.close.get(m.start(), m.start())
            return _body(text, b, after + 1, stop)
        return m.start()
    return -1


def _expression(text: str, at: int) -> bool:
    """Whether what starts at a place is part of an expression, not a declaration."""
    before = text[max(0, at - 80) : at].rstrip()
    return before.endswith(tuple("=(,:?&|!+-[")) or bool(re.search(r"\b(?:return|abstract|new)$", before))


def _typescript(text: str, b: _Brackets):
    """(start, end, name, kind, class around it, place of the name) of each definition."""
    classes = []
    for m in _TS_CLASS.finditer(text):
        open_at = text.find("{", m.end())
        if open_at >= 0 and not _expression(text, m.start()):
            classes.append((m.start(), b.close.get(open_at, len(text)), m[1], "class", None, m.start(1), open_at))
    inside = lambda at: max((c for c in classes if c[0] < at <= c[1]), default=None)
    found = [c[:6] for c in classes]
    for m in _TS_FUNCTION.finditer(text):
        open_at = _body(text, b, b.close.get(m.end() - 1, m.end()) + 1, ";")
        if open_at >= 0 and not _expression(text, m.start()):
            c = inside(m.start())
            found.append((m.start(), b.close.get(open_at, len(text)), m[1], "function", c and c[2], m.start(1)))
    for c in classes:
        for m in _TS_METHOD.finditer(text, c[6] + 1, c[1]):
            if b.around(m.start()) == c[6]:
                open_at = _body(text, b, b.close.get(m.end() - 1, m.end()) + 1, ";=(}")
                if open_at >= 0:
                    found.append((m.start(), b.close.get(open_at, len(text)), m[1], "method", c[2], m.start(1)))
    return sorted(found)


def _go(text: str, b: _Brackets):
    found = []
    for m in _GO_FUNCTION.finditer(text):
        if m[2] not in _KEYWORDS["go"]:
            open_at = _body(text, b, b.close.get(m.end() - 1, m.end()) + 1, "\n")
            end = b.close.get(open_at, len(text)) if open_at >= 0 else m.end()
            found.append((m.start(), end, m[2], "method" if m[1] else "function", "receiver" if m[1] else None, m.start(2)))
    return found


def brace_calls(code: str, language: str):
    """Rows of nodes and edges: ("node", full name, kind, line), ("edge", name of the caller, name of the callee, line)."""
    text = blanked(code)
    b = _Brackets(text)
    found = _go(text, b) if language == "go" else _typescript(text, b)
    line = lambda at: text.count("\n", 0, at) + 1
    nodes = {}
    for start, _, name, kind, around, _ in found:
        nodes[f"{around}.{name}" if around else name] = (kind, line(start + len(text[start:]) - len(text[start:].lstrip())))
    for full, (kind, at) in nodes.items():
        yield "node", full, kind, at
    bodies, named = [f for f in found if f[3] != "class"], {f[5] for f in found}
    at, inner = 0, []
    for m in _CALL.finditer(text):
        while at < len(bodies) and bodies[at][0] <= m.start():
            inner.append(bodies[at])
            at += 1
        while inner and inner[-1][1] < m.start():
            inner.pop()
        if inner and m[1] in nodes and m[1] not in _KEYWORDS[language] and m.start(1) not in named and not re.search(r"\bnew\s*$", text[max(0, m.start() - 8) : m.start()]):
            yield "edge", inner[-1][2], m[1], line(m.start())
