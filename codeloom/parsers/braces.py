"""TypeScript, JavaScript, Apps Script, C# and C++ by a scanner for languages with braces.

Comments and strings are blanked in a copy of equal length; declarations are found in the copy, ends by
matching braces, texts taken from the original. It knows declarations, not whole grammars.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NOT_CALLS = set("if for while switch catch return function typeof sizeof new delete throw await using lock foreach nameof constructor super else do case and or not".split())


class _Source:
    def __init__(self, path: str, text: str, quotes: bool = False):
        self.path, self.text = path, text
        self.code = _BLANK.sub(lambda m: "".join(c if c == "\n" else " " for c in m[0]), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.out: list[dict] = []
        self.spans: list[tuple[int, int, str]] = []

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def block(self, at: int) -> int:
        """The place after the brace that closes the next one opened, or after the next semicolon if that comes first."""
        i, n, depth = at, len(self.code), 0
        while i < n:
            c = self.code[i]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth <= 0:
                    return i + 1
            elif c == ";" and depth == 0:
                return i + 1
            i += 1
        return n

    def symbol(self, at: int, stop: int, kind: str, fqn: str, name: str, context: str | None = None, shared: bool = False) -> None:
        self.spans.append((self.line(at), self.line(max(at, stop - 1)), fqn))
        self.out.append({"record": "symbol", "path": self.path, "fqn": fqn, "kind": kind, "name": name, "class_context": context, "start_line": self.line(at), "end_line": self.line(max(at, stop - 1)), "text": self.text[at:stop], "shared": shared})

    def edge(self, source: str, target: str, kind: str, **more) -> None:
        self.out.append({"record": "edge", "path": self.path, "fqn": source, "target": target, "kind": kind, **more})

    def calls(self, fqn: str, at: int, stop: int, types: dict[str, str] | None = None, bound: dict[str, str] | None = None) -> None:
        """One CALLS edge a callee, with the receiver's type where its name has one known type."""
        found: dict[str, list] = {}
        for m in re.finditer(r"(?:\b([A-Za-z_$][\w$]*)\s*(\.|->|::)\s*)?(?<![\w$#])(#?[A-Za-z_$][\w$]*)\s*(?:<[^<>(){};]*>)?\(", self.code[at:stop]):
            if m[3] not in _NOT_CALLS and len(m[3]) > 1:
                found.setdefault(m[3], []).append(((types or {}).get(m[1] or ""), (bound or {}).get(m[1] or m[3]), m[1] is not None))
        for name, sites in found.items():
            receivers, modules = {s[0] for s in sites}, {s[1] for s in sites}
            self.edge(fqn, name, "CALLS", receiver_type=receivers.pop() if len(receivers) == 1 else None, bound_module=modules.pop() if len(modules) == 1 else None, member_call=any(s[2] for s in sites))

    def references(self) -> None:
        spans = sorted(self.spans)
        for m in re.finditer(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(", self.code):
            if m[1] not in _NOT_CALLS and len(m[1]) > 1:
                line = self.line(m.start())
                around = [f for a, b, f in spans if a <= line <= b]
                self.out.append({"record": "ref", "path": self.path, "name": m[1], "line": line, "kind": "CALL", "fqn": around[-1] if around else None})


def _types_in(code: str, owner: str | None) -> dict[str, str]:
    """Variables with one declared type: ``T x``, ``var x = new T(``, parameters; a name with two types has none."""
    found: dict[str, set] = {}
    for m in re.finditer(r"\b([A-Z]\w*)\s*[*&]?\s+([A-Za-z_]\w*)\s*(?=[=;,){])", code):
        found.setdefault(m[2], set()).add(m[1])
    for m in re.finditer(r"\b(?:var|auto|const|let)\s+([A-Za-z_]\w*)\s*=\s*new\s+([A-Z]\w*)\s*[({]", code):
        found.setdefault(m[1], set()).add(m[2])
    out = {k: v.pop() for k, v in found.items() if len(v) == 1}
    if owner:
        out["this"] = owner
    return out


def parse_script(path: str, text: str) -> list[dict]:
    s = _Source(path, text)
    bound: dict[str, str] = {}
    for m in re.finditer(r"^\s*(?:import|export)\b([^;'\"]*?)\bfrom\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", text, re.M):
        spec = m[2] or m[3] or m[4]
        if not any(e["target"] == spec for e in s.out):
            s.edge(path, spec, "IMPORTS")
        for name in re.findall(r"([A-Za-z_$][\w$]*)\s*(?=,|\}|$|\s*$)", (m[1] or "").replace("type ", "")):
            bound[name] = spec
    taken: list[tuple[int, int]] = []
    for m in re.finditer(r"\b(class|interface|enum)\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?([^{;=()]*)\{", s.code):
        stop, fqn = s.block(m.end() - 1), f"{path}::{m[2]}"
        s.symbol(m.start(), stop, m[1], fqn, m[2])
        if h := re.search(r"\bextends\s+([\w$.]+)", m[3]):
            s.edge(fqn, h[1].split(".")[-1], "EXTENDS")
        if h := re.search(r"\bimplements\s+(.+)", m[3], re.S):
            for base in h[1].split(","):
                if name := re.match(r"\s*([\w$.]+)", base):
                    s.edge(fqn, name[1].split(".")[-1], "IMPLEMENTS")
        if m[1] == "class":
            taken.append((m.end(), stop))
            depth = 0
            types = _types_in(s.code[m.end() : stop], m[2])
            for k in re.finditer(r"[{}]|(?:^|(?<=[;{}\n]))[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*\*?(#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*[^{};=]+)?(?=\{)", s.code[m.end() : stop - 1]):
                if k[0] in "{}":
                    depth += 1 if k[0] == "{" else -1
                elif depth == 0 and k[1] not in _NOT_CALLS | {"constructor"} or depth == 0 and k[1] == "constructor":
                    at = m.end() + k.start() + len(k[0]) - len(k[0].lstrip())
                    end = s.block(m.end() + k.end())
                    name = f"{fqn}.{k[1]}"
                    s.symbol(at, end, "method", name, k[1], m[2])
                    s.edge(fqn, name, "OWNS")
                    s.calls(name, m.end() + k.end(), end, types, bound)
    inside = lambda at: any(a <= at < b for a, b in taken)
    for m in re.finditer(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\(", s.code):
        if not inside(m.start()):
            stop, fqn = s.block(m.end()), f"{path}::{m[1]}"
            s.symbol(m.start(), stop, "function", fqn, m[1])
            s.calls(fqn, m.end(), stop, None, bound)
    for m in re.finditer(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^=;{]+)?=>", s.code):
        if not inside(m.start()):
            stop, fqn = s.block(m.end()), f"{path}::{m[1]}"
            s.symbol(m.start(), stop, "arrow_function", fqn, m[1])
            s.calls(fqn, m.end(), stop, None, bound)
    for m in re.finditer(r"\btype\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=", s.code):
        s.symbol(m.start(), s.block(m.end()), "type_alias", f"{path}::{m[1]}", m[1])
    spans = sorted(s.spans)
    for pattern, kind in ((r"<([A-Za-z_][\w.]*\.Provider)\b", "PROVIDES_CONTEXT"), (r"\buseContext\(\s*([A-Z]\w*)", "CONSUMES_CONTEXT")):
        for m in re.finditer(pattern, s.code):
            line = s.line(m.start())
            s.edge(next((f for a, b, f in spans if a <= line <= b), path), m[1], kind)
    s.references()
    return s.out


def parse_csharp(path: str, text: str) -> list[dict]:
    """FQNs are Ns.Outer+Inner and Owner.Name/arity, without the path; symbols may stand in several files."""
    s = _Source(path, text)
    for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", s.code, re.M):
        s.edge(path, m[1], "IMPORTS")
    spaces = [(m.start(), s.block(m.end() - 1) if m[2] == "{" else len(s.code), m[1]) for m in re.finditer(r"\bnamespace\s+([\w.]+)\s*([{;])", s.code)]
    types: list[tuple[int, int, str]] = []
    for m in re.finditer(r"\b(partial\s+)?(class|interface|struct|record|enum)\s+([A-Za-z_]\w*)(?:\s*<[^>{]*>)?(?:\s*\([^()]*\))?([^{;]*)[{;]", s.code):
        stop = s.block(m.end() - 1)
        space = ".".join(n for a, b, n in spaces if a <= m.start() < b)
        outer = [f for a, b, f in types if a <= m.start() < b]
        fqn = f"{outer[-1]}+{m[3]}" if outer else f"{space}.{m[3]}".lstrip(".")
        types.append((m.start(), stop, fqn))
        s.symbol(m.start(), stop, "partial_class" if m[1] and m[2] == "class" else m[2], fqn, m[3], None, True)
        if outer:
            s.edge(outer[-1], fqn, "OWNS")
        bases = re.sub(r"<[^<>]*>", "", m[4].split(" where ")[0]).strip()
        if bases.startswith(":") and m[2] != "enum":
            for i, base in enumerate(b.strip() for b in bases[1:].split(",")):
                if base:
                    s.edge(fqn, re.sub(r"\(.*", "", base).split(".")[-1], "EXTENDS" if i == 0 else "IMPLEMENTS")
    for m in re.finditer(r"(?:\b(?:public|private|protected|internal|static|virtual|override|async|abstract|sealed|extern|partial)\s+)+(?:([\w.<>\[\],?]+)\s+)?([A-Za-z_]\w*)\s*(?:<[^>(]*>)?(\(([^()]*(?:\([^()]*\)[^()]*)*)\)|(?=\s*(?:\{|=>)))", s.code):
        owner = [(a, f) for a, b, f in types if a < m.start() < b]
        if not owner or m[2] in ("class", "interface", "struct", "record", "enum", "namespace", "operator"):
            continue
        at, fqn = owner[-1]
        stop, simple = s.block(m.end()), re.split(r"[.+]", fqn)[-1]
        if m[3].startswith("("):
            params = re.sub(r"<[^<>]*>", "", m[4] or "").strip()
            name = f"{fqn}.{m[2]}/{params.count(',') + 1 if params else 0}"
            s.symbol(m.start(), stop, "constructor" if m[2] == simple else "method", name, m[2], simple, True)
            end = next(b for a, b, f in types if a == at and f == fqn)
            s.calls(name, m.end(), stop, _types_in(s.code[at:end], None) | _types_in(s.code[m.start() : stop], simple))
        else:
            name = f"{fqn}.{m[2]}"
            s.symbol(m.start(), stop, "property", name, m[2], simple, True)
        s.edge(fqn, name, "OWNS")
    s.references()
    return s.out


def _cpp_params(text: str) -> str:
    """Parameter types without names and defaults; no space before ``*`` or ``&``."""
    out = []
    for p in re.split(r",(?![^<]*>)", text):
        p = re.sub(r"\s+", " ", p.split("=")[0]).strip()
        if p in ("", "void"):
            continue
        if p != "..." and re.search(r"[\w>&*]\s*[ *&]\s*[A-Za-z_]\w*(\[\])?$", p):
            p = re.sub(r"[A-Za-z_]\w*(\[\])?$", r"\1", p).strip()
        out.append(re.sub(r"\s+([*&])", r"\1", p))
    return ",".join(out)


def parse_cpp(path: str, text: str) -> list[dict]:
    """FQNs are namespaced with parameter types; every base is an EXTENDS edge; all symbols are shared."""
    s = _Source(path, text)
    for m in re.finditer(r"^\s*#\s*include\s*(?:\"([^\"]+)\"|(<[^>]+>))", text, re.M):
        s.edge(path, m[1] or m[2], "IMPORTS")
    spaces = [(m.start(), s.block(m.end() - 1), m[1]) for m in re.finditer(r"\bnamespace\s+([\w:]+)\s*\{", s.code)]
    types: list[tuple[int, int, str, str]] = []
    around = lambda at: "::".join(n for a, b, n in spaces if a <= at < b)
    for m in re.finditer(r"(?:\btemplate\s*<[^;{}]*>\s*)?\b(class|struct|enum(?:\s+class)?)\s+([A-Za-z_]\w*)([^{;()]*)\{", s.code):
        stop = s.block(m.end() - 1)
        outer = [f for a, b, f, _ in types if a <= m.start() < b]
        fqn = "::".join(x for x in (outer[-1] if outer else around(m.start()), m[2]) if x)
        kind = "enum" if m[1].startswith("enum") else m[1]
        types.append((m.start(), stop, fqn, m[2]))
        s.symbol(m.start(), stop, kind, fqn, m[2], None, True)
        if kind != "enum" and ":" in m[3]:
            for base in re.split(r",(?![^<]*>)", m[3].split(":", 1)[1]):
                if name := re.sub(r"<.*>|\b(public|private|protected|virtual)\b", "", base).strip():
                    s.edge(fqn, name.split("::")[-1], "EXTENDS")
    for m in re.finditer(r"(?:^|(?<=[;{}:\n]))[ \t]*(?:template\s*<[^;{}]*>\s*)?((?:[\w:<>,&*~]+[ \t&*]+)*)((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*|operator\s*[^\s(]+)\s*\(([^(){};]*)\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?(?=\{)", s.code, re.M):
        parts = m[2].split("::")
        if parts[-1] in _NOT_CALLS or "return" in m[1] or "new" in m[1].split():
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        owner = [(f, n) for a, b, f, n in types if a < at < b]
        params, stop = _cpp_params(m[3]), s.block(m.end())
        if owner:
            fqn, simple = owner[-1]
        elif len(parts) > 1:
            fqn, simple = "::".join(x for x in (around(at), *parts[:-1]) if x), parts[-2]
        else:
            fqn, simple = "", None
        base = fqn or around(at)
        name = f"{base}::{parts[-1]}({params})".removeprefix("::")
        kind = "function" if simple is None else "destructor" if parts[-1].startswith("~") else "constructor" if parts[-1] == simple else "method"
        s.symbol(at, stop, kind, name, parts[-1], simple, True)
        if simple:
            s.edge(fqn, name, "OWNS")
        fields = next((s.code[a:b] for a, b, f, _ in types if f == fqn), "")
        s.calls(name, m.end(), stop, _types_in(fields, None) | _types_in(s.code[at:stop], simple))
    for pattern, kind in ((r"\btypedef\s+[^;{}]*?\b([A-Za-z_]\w*)\s*;", "typedef"), (r"\busing\s+([A-Za-z_]\w*)\s*=[^;]*;", "type_alias")):
        for m in re.finditer(pattern, s.code):
            s.symbol(m.start(), m.end(), kind, "::".join(x for x in (around(m.start()), m[1]) if x), m[1], None, True)
    s.references()
    return s.out


def skeleton(text: str) -> str:
    """Bodies of functions and methods become `` { ... }``; types and declarations stay."""
    s, out, at = _Source("", text), [], 0
    for m in re.finditer(r"\)\s*(?:const|noexcept|override|:\s*[^{};=]+|\s)*\{", s.code):
        if m.start() < at:
            continue
        stop = s.block(m.end() - 1)
        out.append(text[at : m.end() - 1].rstrip() + " { ... }")
        at = stop
    return "".join(out) + text[at:]
