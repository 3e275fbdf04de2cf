"""Controller exports (L5X): modules, tags, programs, routines, add-on instructions, reads and writes."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

#: Spellings of one instruction.
ALIASES = {"MOVE": "MOV", "EQ": "EQU", "NE": "NEQ", "LT": "LES", "GT": "GRT", "LE": "LEQ", "GE": "GEQ", "LIMIT": "LIM"}
#: Operands by place, as the instruction manual describes them. r reads a tag, w writes one, l is a literal,
#: k a keyword, j a label, e an expression, s a routine.
OPERANDS = {
    # bits
    "XIC": ("r",),
    "XIO": ("r",),
    "OTE": ("w",),
    "OTL": ("w",),
    "OTU": ("w",),
    "ONS": ("w",),
    "OSR": ("w", "w"),
    "OSF": ("w", "w"),
    # timers and counters: the structure, preset and accumulated value
    "TON": ("w", "l", "l"),
    "TOF": ("w", "l", "l"),
    "RTO": ("w", "l", "l"),
    "CTU": ("w", "l", "l"),
    "CTD": ("w", "l", "l"),
    "RES": ("w",),
    # comparison
    "CMP": ("e",),
    "EQU": ("r", "r"),
    "NEQ": ("r", "r"),
    "GRT": ("r", "r"),
    "GEQ": ("r", "r"),
    "LES": ("r", "r"),
    "LEQ": ("r", "r"),
    "LIM": ("r", "r", "r"),
    "MEQ": ("r", "r", "r"),
    # arithmetic and conversion
    "CPT": ("w", "e"),
    "ADD": ("r", "r", "w"),
    "SUB": ("r", "r", "w"),
    "MUL": ("r", "r", "w"),
    "DIV": ("r", "r", "w"),
    "MOD": ("r", "r", "w"),
    "SQR": ("r", "w"),
    "NEG": ("r", "w"),
    "ABS": ("r", "w"),
    # moves and logic
    "MOV": ("r", "w"),
    "MVM": ("r", "r", "w"),
    "CLR": ("w",),
    "BTD": ("r", "l", "w", "l", "l"),
    "SWPB": ("r", "k", "w"),
    "AND": ("r", "r", "w"),
    "OR": ("r", "r", "w"),
    "XOR": ("r", "r", "w"),
    "NOT": ("r", "w"),
    # arrays and files
    "COP": ("r", "w", "r"),
    "CPS": ("r", "w", "r"),
    "FLL": ("r", "w", "r"),
    "SIZE": ("r", "l", "w"),
    "FAL": ("w", "l", "l", "k", "w", "e"),
    "FSC": ("w", "l", "l", "k", "e"),
    # strings
    "CONCAT": ("r", "r", "w"),
    "DELETE": ("r", "r", "l", "w"),
    "FIND": ("r", "r", "l", "w"),
    "INSERT": ("r", "r", "l", "w"),
    "MID": ("r", "r", "l", "w"),
    "DTOS": ("r", "w"),
    "RTOS": ("r", "w"),
    "STOD": ("r", "w"),
    "STOR": ("r", "w"),
    # program control
    "JMP": ("j",),
    "LBL": ("j",),
    "JSR": ("s", "l", "r"),
    "JXR": ("s", "l", "r"),
    "SBR": ("r",),
    "RET": ("r",),
    "MCR": (),
    "AFI": (),
    "NOP": (),
    "TND": (),
    "UID": (),
    "UIE": (),
    # system values, messages, loops
    "GSV": ("k", "k", "k"),
    "SSV": ("k", "k", "k"),
    "MSG": ("w",),
    "PID": ("w", "r", "r", "w"),
}
#: Instructions that repeat their last operand; the role of the last operand, whatever its place.
REPEATING = {"JSR", "JXR", "SBR", "RET"}
LAST = {"GSV": "w", "SSV": "r"}
_WORD = re.compile(r"[A-Za-z_][\w]*")
_EXPRESSION_WORDS = {"AND", "OR", "XOR", "NOT", "MOD"}


def role(mnemonic: str, place: int, arity: int) -> str:
    """The letter of OPERANDS; tags of unknown instructions, and further operands, are only read."""
    if mnemonic in LAST and place == arity - 1:
        return LAST[mnemonic]
    places = OPERANDS.get(mnemonic, ())
    if mnemonic in REPEATING:
        place = min(place, len(places) - 1)
    return places[place] if place < len(places) else "r"


def instructions(text: str) -> Iterator[tuple[str, list[str]]]:
    """Top-level calls of a rung; operands are parted at commas outside inner brackets, empty ones stay."""
    at = 0
    while m := re.compile(r"[A-Za-z_]\w*\(").search(text, at):
        depth, square, start, operands, i = 1, 0, m.end(), [], m.end()
        while i < len(text) and depth:
            c = text[i]
            depth += (c == "(") - (c == ")")
            square += (c == "[") - (c == "]")
            if depth == 0 or (c == "," and depth == 1 and square == 0):
                operands.append(text[start:i].strip())
                start = i + 1
            i += 1
        yield ALIASES.get(m[0][:-1], m[0][:-1]), operands if operands != [""] else []
        at = i


def operand(text: str) -> tuple[str | None, list[str]]:
    """The base tag (module addresses keep their colons) and the names read in its subscripts."""
    inner = [w for part in re.findall(r"\[([^\[\]]*)\]", text) for w in _WORD.findall(re.sub(r"\.[A-Za-z_]\w*", "", part)) if w.upper() not in _EXPRESSION_WORDS]
    m = re.match(r"[A-Za-z_][\w:]*", text.strip())
    return (m[0].rstrip(":") if m else None), inner


def terms(text: str) -> list[str]:
    """Tag references of an expression; operators and function names aren't."""
    found = re.finditer(r"[A-Za-z_][\w:]*(?:\[[^\]]*\]|\.\w+)*", text)
    return [m[0] for m in found if m[0].upper() not in _EXPRESSION_WORDS and text[m.end() :].lstrip()[:1] != "("]


def _text(node) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def parse(path: str, text: str) -> list[dict]:
    """Records of a whole-controller export; other exports give none. A reference's line is its rung's number."""
    root = ET.fromstring(text.lstrip("﻿"))
    if root.get("TargetType") != "Controller" or root.get("ContainsContext", "false") == "true":
        return []
    out: list[dict] = []
    edges: set[tuple[str, str, str]] = set()
    number = iter(range(1, 10**9))

    def symbol(fqn: str, kind: str, name: str, body: str = "", context: str | None = None) -> None:
        line = next(number)
        out.append({"record": "symbol", "path": path, "fqn": fqn, "kind": kind, "name": name, "class_context": context, "start_line": line, "end_line": line, "text": body, "shared": False})

    def edge(source: str, target: str, kind: str) -> None:
        if (source, target, kind) not in edges:
            edges.add((source, target, kind))
            out.append({"record": "edge", "path": path, "fqn": source, "target": target, "kind": kind})

    controller = root.find("Controller")
    if controller is None:
        return out
    for m in controller.iterfind("Modules/Module"):
        parent = m.get("ParentModule", "")
        port = m.find("Ports/Port")
        name = m.get("Name") or f"{parent}:{m.get('ParentModPortId', '')}:{port.get('Address', '') if port is not None else ''}"
        symbol(name, "module", name, m.get("CatalogNumber", ""))
        if parent and parent != name:
            edge(parent, name, "OWNS")

    def tags(parent, prefix: str, context: str | None) -> dict[str, str]:
        scope = {}
        for t in parent.iterfind("Tags/Tag"):
            fqn = prefix + t.get("Name", "")
            scope[t.get("Name", "")] = fqn
            symbol(fqn, "tag", t.get("Name", ""), f"{t.get('DataType', '')} {_text(t.find('Description'))}".strip(), context)
            if context:
                edge(context, fqn, "OWNS")
        return scope

    globals_ = tags(controller, "", None)
    parameters: dict[str, list[tuple[str, str]]] = {}
    bodies: list[tuple] = []  # (routine element, fqn, scope, program)

    def routine_text(r) -> str:
        rows = [r.get("Name", ""), _text(r.find("Description"))]
        for rung in r.iter("Rung"):
            rows += [f"[{rung.get('Number')}] {_text(rung.find(k))}" for k in ("Comment", "Text") if _text(rung.find(k))]
        return "\n".join(x for x in rows if x)

    def routines(parent, owner: str, scope: dict, program: str | None) -> None:
        for r in parent.iterfind("Routines/Routine"):
            fqn = f"{owner}.{r.get('Name', '')}"
            symbol(fqn, "routine", r.get("Name", ""), routine_text(r), owner)
            edge(owner, fqn, "OWNS")
            bodies.append((r, fqn, scope, program))

    for a in controller.iterfind("AddOnInstructionDefinitions/AddOnInstructionDefinition"):
        name, scope = a.get("Name", ""), {}
        symbol(name, "aoi", name, _text(a.find("Description")))
        parameters[name] = []
        for kind, place in (("parameter", "Parameters/Parameter"), ("local_tag", "LocalTags/LocalTag")):
            for p in a.iterfind(place):
                if p.get("Name") in ("EnableIn", "EnableOut"):
                    continue
                fqn = f"{name}.{p.get('Name', '')}"
                scope[p.get("Name", "")] = fqn
                symbol(fqn, kind, p.get("Name", ""), p.get("DataType", ""), name)
                edge(name, fqn, "OWNS")
                if kind == "parameter" and p.get("Required") == "true":
                    parameters[name].append((p.get("Name", ""), p.get("Usage", "InOut")))
        routines(a, name, scope, None)
    programs: dict[str, set[str]] = {}
    for p in controller.iterfind("Programs/Program"):
        name = p.get("Name", "")
        symbol(name, "program", name, _text(p.find("Description")))
        scope = {**globals_, **tags(p, f"{name}.", name)}
        programs[name] = {r.get("Name", "") for r in p.iterfind("Routines/Routine")}
        routines(p, name, scope, name)
    for t in controller.iter("Tag"):
        if t.get("AliasFor") and (base := operand(t.get("AliasFor"))[0]):
            edge(t.get("Name", ""), globals_.get(base, base), "ALIAS_OF")

    for r, fqn, scope, program in bodies:
        if r.get("Type", "RLL") != "RLL":
            continue
        for rung in r.iter("Rung"):
            raw = rung.get("Number")
            line = int(raw) if raw and raw.lstrip("-").isdigit() else None

            def touch(name: str | None, kind: str) -> None:
                to = name if name and ":" in name else scope.get(name or "")  # noqa: B023
                if to:
                    edge(fqn, to, {"READ": "READS", "WRITE": "WRITES"}[kind])  # noqa: B023
                    out.append({"record": "ref", "path": path, "name": name, "target": to, "line": line, "kind": kind, "fqn": fqn})  # noqa: B023

            def call(name: str, target: str) -> None:
                edge(fqn, target, "CALLS")  # noqa: B023
                out.append({"record": "ref", "path": path, "name": name, "target": target, "line": line, "kind": "CALL", "fqn": fqn})  # noqa: B023

            def use(text_: str, how: str) -> None:
                base, inner = operand(text_)
                for name in inner:
                    touch(name, "READ")
                for c in how:
                    touch(base, {"r": "READ", "w": "WRITE"}[c])

            for mnemonic, operands in instructions(_text(rung.find("Text"))):
                if mnemonic in parameters:
                    call(mnemonic, mnemonic)
                    if operands:
                        touch(operand(operands[0])[0], "WRITE")
                    if len(operands) - 1 == len(parameters[mnemonic]):
                        for (_, usage), actual in zip(parameters[mnemonic], operands[1:]):
                            use(actual, {"Input": "r", "Output": "w"}.get(usage, "rw"))
                    continue
                for i, o in enumerate(operands):
                    kind = role(mnemonic, i, len(operands))
                    if not o or kind in "lkj-":
                        continue
                    if kind == "s":
                        base = operand(o)[0]
                        if base and program and base in programs[program]:
                            call(base, f"{program}.{base}")
                    elif kind == "e":
                        for t in terms(o):
                            use(t, "r")
                    else:
                        use(o, kind)
    return out


def aoi_hashes(path: str, text: str) -> list[dict]:
    """For each add-on instruction: name, revision and hashes of its signature, logic and comments."""
    controller = ET.fromstring(text.lstrip("﻿")).find("Controller")
    out = []
    for a in controller.iterfind("AddOnInstructionDefinitions/AddOnInstructionDefinition") if controller is not None else ():
        sig = "|".join(f"{p.get('Name')}:{p.get('DataType')}:{p.get('Usage')}:{p.get('Required')}" for p in a.iterfind("Parameters/Parameter"))
        logic = "|".join(_text(r.find("Text")) for r in a.iter("Rung"))
        notes = "|".join(_text(r.find("Comment")) for r in a.iter("Rung"))
        short = [hashlib.sha256(x.encode()).hexdigest()[:12] for x in (sig, logic, notes)]
        out.append({"path": path, "name": a.get("Name", ""), "revision": a.get("Revision", ""), "signature": short[0], "logic": short[1], "comments": short[2]})
    return out


def drift(definitions):
    """Verdict of each (name, revision): SIGNATURE DRIFT, DRIFT, COMMENT DRIFT, single or consistent. Takes a DataFrame of ``aoi_hashes``."""
    from pyspark.sql import functions as F

    n = definitions.groupBy("name", "revision").agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(c) for c in ("signature", "logic", "comments")))
    how = F.when(F.col("signature") > 1, "SIGNATURE DRIFT").when(F.col("logic") > 1, "DRIFT").when(F.col("comments") > 1, "COMMENT DRIFT").when(F.col("n") == 1, "single").otherwise("consistent")
    return n.select("name", "revision", "n", how.alias("verdict"))
