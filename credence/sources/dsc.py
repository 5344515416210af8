"""Networks in DSC format.

Sections start with `belief network`, `node` or `probability`; other lines
between them are skipped, `//` starts a comment. Conditional rows are keyed by
state numbers. The last of several rows for a configuration counts.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..network import Model, Network, NetworkError, Variable, configurations
from .files import read_text

_NAME = r'"?([^"{}()|,;]+?)"?'
_HEADER = re.compile(r'^belief\s+network\s*(?:"([^"]*)"|(\S*))')
_NODE = re.compile(rf"^node\s+{_NAME}\s*(\{{.*)?$")
_TYPE = re.compile(r"type\s*:?\s*discrete\s*\[\s*(\d+)\s*\](?:\s*=\s*\{([^}]*)\})?")
_TABLE = re.compile(rf"^probability\s*\(\s*{_NAME}\s*(?:\|\s*([^)]*))?\)\s*(\{{.*)?$")
_ROW = re.compile(r"\(\s*([\d\s,]+)\)\s*:\s*([^;]+);")


def lines_of(text: str) -> list[str]:
    """Lines without a trailing carriage return, comment or leading space; empty ones are left out."""
    out = (re.sub(r"//.*$", "", line.rstrip("\r")).strip() for line in text.split("\n"))
    return [line for line in out if line]


def _sections(lines: list[str]):
    """(first line, everything between its braces)."""
    i = 0
    while i < len(lines):
        line = lines[i]
        if re.match(r"(node|probability)\b", line):
            body, depth = line, line.count("{") - line.count("}")
            opened = "{" in line
            while (not opened or depth > 0) and i + 1 < len(lines):
                i += 1
                body += "\n" + lines[i]
                depth += lines[i].count("{") - lines[i].count("}")
                opened |= "{" in lines[i]
            if not opened or depth:
                raise NetworkError(f"no closing brace after: {line}")
            yield line.split("{")[0].strip(), body[body.index("{") + 1 : body.rindex("}")]
        else:
            yield line, ""
        i += 1


def parse(text: str) -> Model:
    name, variables, tables = "network", [], []
    for head, body in _sections(lines_of(text)):
        if m := _HEADER.match(head):
            name = m[1] or m[2] or name
        elif m := _NODE.match(head):
            kind = _TYPE.search(body)
            if not kind:
                raise NetworkError(f"node {m[1]} has no discrete type")
            states = tuple(s.strip().strip('"') for s in kind[2].split(",")) if kind[2] else ()
            variables.append(Variable(len(variables), m[1].strip(), int(kind[1]), states))
        elif m := _TABLE.match(head):
            tables.append((m[1].strip(), [p.strip().strip('"') for p in (m[2] or "").split(",") if p.strip()], body))
    network = Network(tuple(variables), (), name)
    for target, parents, _ in tables:
        for p in parents:
            network = network.require_edge(p, target)
    made: dict[int, dict[tuple[int, ...], tuple[float, ...]]] = {}
    for target, given, body in tables:
        v = network[target]
        parents = network.parents(v)
        order = [given.index(p.name) for p in parents]
        if not given:
            made[v.id] = {(): tuple(float(x) for x in re.split(r"[\s,]+", body.split(";")[0].strip()))}
            continue
        rows = {c: (0.0,) * v.card for c in configurations(p.card for p in parents)}
        for key, values in _ROW.findall(body):
            states = [int(x) for x in key.split(",")]
            config = tuple(states[i] for i in order)
            if len(states) != len(given) or config not in rows:
                raise NetworkError(f"probability of {target}: no configuration ({key.strip()})")
            rows[config] = tuple(float(x) for x in re.split(r"[\s,]+", values.strip()))
        made[v.id] = rows
    return Model(network, made)


def read(spark: SparkSession, path: str) -> Model:
    return parse(read_text(spark, path))


def spell(model: Model) -> str:
    """The model in this format."""
    net, out = model.network, [f'belief network "{model.network.name}"']
    for v in net.variables:
        states = " = {" + ", ".join(f'"{s}"' for s in v.states) + "}" if v.states else ""
        out += [f"node {v.name}", "{", f"  type: discrete[{v.card}]{states};", "}"]
    for v in net.variables:
        parents = net.parents(v)
        out += [f"probability({v.name}{' | ' + ', '.join(p.name for p in parents) if parents else ''})", "{"]
        for c, row in sorted(model.tables[v.id].items()):
            key = f"({', '.join(map(str, c))}): " if c else ""
            out.append(f"  {key}{', '.join(map(repr, row))};")
        out.append("}")
    return "\n".join(out) + "\n"
