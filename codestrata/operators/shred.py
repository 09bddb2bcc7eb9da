"""Deeply nested semi-structured records into related flat tables.

Structural-variant tables: a bottom-up tree automaton gives every node of a document's JSON tree a state from its label
and its children's states. The state of an object says which variant of record it is (function, class, parameter, call
reference, complexity, container) and whether it holds entities; the state of a member (a key with its value's state) says
what it is to its owner: parameters, calls, complexity, further entities or a plain field. A top-down pass follows these
states and nothing else, whatever the keys are called on the way, and routes each variant to its typed subtype table; all
tables share the supertype keys (document id, node number, number of the enclosing node) so that every child stays tied to
its entity and every entity to what encloses it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread, written

#: One row per routed record. `variant` tells the subtype; columns that a variant lacks are null.
NODE_SCHEMA = (
    "dump_id bigint, node int, parent_node int, variant string, entity_id string, owner_id string, pos int, "
    "name string, file string, entity_type string, signature string, docstring string, type_hint string, number bigint, shape string"
)
VARIANTS = ("entity", "parameter", "call", "cyclomatic", "invalid")
#: Keys that mark an object without a declared type.
CLASS_KEYS = frozenset({"bases", "methods", "nested_classes", "metaclass"})
FUNCTION_KEYS = frozenset({"parameters", "calls", "signature", "complexity"})
#: Members of an entity that are its own children; their form tells the variant.
CHILD_KEYS = {"parameters": "parameters", "calls": "calls", "complexity": "complexity"}


class ShapeAutomaton:
    """Deterministic bottom-up automaton over JSON trees; `rules` keeps the state of every distinct object shape met.

    A state is (kind, holds): what a value is, and whether there is an entity in it.
    """

    def __init__(self) -> None:
        self.rules: dict[tuple, tuple[str, bool]] = {}

    def leaf(self, v: object) -> tuple[str, bool]:
        if v is None:
            return "null", False
        if isinstance(v, bool):
            return "truth", False
        return ("number" if isinstance(v, (int, float)) else "text"), False

    def object_state(self, o: dict, states: dict[str, tuple[str, bool]]) -> tuple[str, bool]:
        declared = o.get("type")
        label = declared if isinstance(declared, str) and declared in ("function", "class") else ""
        shape = (label, *sorted(states.items())) if len(states) <= 40 else None
        if shape is not None and (hit := self.rules.get(shape)):
            return hit
        keys = states.keys()
        below = any(holds for _, holds in states.values())
        named = states.get("name", ("", False))[0] == "text"
        if label or named and keys & CLASS_KEYS or named and keys & FUNCTION_KEYS:
            state = label or ("class" if keys & CLASS_KEYS else "function"), True
        elif "cyclomatic" in keys and not below:
            state = "complexity", False
        elif named:
            state = "named", below
        else:
            state = "container", below
        if shape is not None and len(self.rules) < 100_000:
            self.rules[shape] = state
        return state

    def list_state(self, states: list[tuple[str, bool]]) -> tuple[str, bool]:
        return "list", any(holds for _, holds in states)

    @staticmethod
    def member(key: str, state: tuple[str, bool]) -> str:
        """What a member of an entity is: parameters, calls and complexity with their form, 'entities', or 'field'."""
        kind, holds = state
        if key in CHILD_KEYS:
            form = {"list": "list", "named": "one", "container": "map", "complexity": "record", "function": "one", "class": "one"}.get(kind, kind)
            return f"{CHILD_KEYS[key]}:{form}" if kind != "null" else "field"
        return "entities" if holds else "field"

    def run(self, root: object) -> dict[int, tuple[str, bool]]:
        """State of every object and list by id(); bottom-up with an own stack, so depth is bounded by memory only."""
        states: dict[int, tuple[str, bool]] = {}
        order, stack = [], [root]
        while stack:
            v = stack.pop()
            if isinstance(v, (dict, list)):
                order.append(v)
                stack.extend(v.values() if isinstance(v, dict) else v)
        of = lambda v: states[id(v)] if isinstance(v, (dict, list)) else self.leaf(v)
        for v in reversed(order):
            states[id(v)] = self.object_state(v, {k: of(x) for k, x in v.items()}) if isinstance(v, dict) else self.list_state([of(x) for x in v])
        return states


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def read_json(text: str) -> object:
    """A JSON value of any depth, or ValueError; NaN and Infinity aren't JSON. The usual reader is tried first, which gives up on deep nesting."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str) -> object:
    skip = lambda i: _BLANK.match(text, i).end()
    open_: list[tuple[object, str | None]] = []  # containers being read, each with the key under which it will be put
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            box: object = {} if c == "{" else []
            at = skip(at + 1)
            key = None
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, at = _key(text, at, skip)
                open_.append((box, key))
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif (m := _NUMBER.match(text, at)) is not None:
            value, at = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at = _WORDS[word], at + len(word)
        # Put the value where it belongs and close what ends after it.
        while open_:
            box, key = open_.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(box, dict):
                    key, at = _key(text, at, skip)
                open_.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no end at {at}")
            value, at = box, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError(f"more at {at}")
            return value


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, skip(at + 1)


def _text(v: object) -> str | None:
    return v if isinstance(v, str) and v != "" else None


def _path(v: object) -> str | None:
    if not isinstance(v, str):
        return None
    v = v.replace("\\", "/")
    while v.startswith("./"):
        v = v[2:]
    return v or None


def _integer(v: object) -> int | None:
    """The number as an integer: 7, 7.0, '7' and ' 7 ' are 7; booleans, fractions, other text and beyond 64 bits are none."""
    if isinstance(v, bool) or v is None:
        return None
    try:
        x = int(v.strip()) if isinstance(v, str) and v.strip().lstrip("+-").isdigit() else float(v) if isinstance(v, (str, float)) else int(v) if isinstance(v, int) else None
        if isinstance(x, float):
            x = int(x) if x == int(x) else None
        return x if x is not None and -(2**63) <= x < 2**63 else None
    except (ValueError, OverflowError):
        return None


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def shred_payload(payload: str | None, automaton: ShapeAutomaton) -> list[tuple] | None:
    """Rows of NODE_SCHEMA without dump_id, or None where the payload isn't valid JSON."""
    if payload is None:
        return None
    try:
        root = read_json(payload)
    except ValueError:
        return None
    states = automaton.run(root)
    state = lambda v: states[id(v)] if isinstance(v, (dict, list)) else automaton.leaf(v)
    # Top-down along the states that hold entities: each with its enclosing entity (by node number), file in force and the key it is stored under.
    entities: list[dict] = []
    stack: list[tuple] = [(root, None, None, None)]
    while stack:
        v, key, outer, file = stack.pop()
        if not state(v)[1]:
            continue
        if isinstance(v, list):
            stack.extend((x, None, outer, file) for x in reversed(v))
            continue
        kind = state(v)[0]
        if kind in ("function", "class"):
            here = _path(v.get("file")) or file
            members = {k: automaton.member(k, state(x)) for k, x in v.items()}
            entities.append({"o": v, "key": key, "outer": outer, "file": here, "kind": kind, "members": members})
            me = len(entities) - 1
            inner = [(v[k], None, me, here) for k, role in members.items() if role == "entities"]
        else:
            here = _path(v.get("file_path")) or _path(v.get("path")) or _path(v.get("file")) or file
            inner = [(x, k, outer, here) for k, x in v.items()]
        stack.extend(reversed(inner))
    for e in entities:
        o, outer = e["o"], e["outer"]
        e["name"] = _text(o.get("name"))
        e["parent_class"] = _text(o.get("parent_class")) or (entities[outer]["name"] if outer is not None and e["kind"] == "function" and entities[outer]["kind"] == "class" else None)
        key = e["key"] if isinstance(e["key"], str) and (":" in e["key"]) else None
        eid = _path(o.get("unique_id")) or _path(key)
        if eid is None and e["name"]:
            eid = ":".join(x for x in (e["file"], f"{e['parent_class']}.{e['name']}" if e["parent_class"] else e["name"]) if x)
        e["id"] = eid
    # Classes by file and name, and which class names which as nested, for records that are not stored inside their class.
    by_name: dict[tuple, int] = {}
    nests: dict[tuple, int] = {}
    for i, e in enumerate(entities):
        if e["kind"] == "class":
            by_name.setdefault((e["file"], e["name"]), i)
            for x in e["o"].get("nested_classes") or [] if isinstance(e["o"].get("nested_classes"), list) else []:
                if _text(x):
                    nests.setdefault((e["file"], x), i)
    rows: list[tuple] = []
    node = len(entities)
    for i, e in enumerate(entities):
        o, outer = e["o"], e["outer"]
        owner, parent = None, outer
        if e["parent_class"] is not None and (e["kind"] == "function" or outer is None):
            parent = by_name.get((e["file"], e["parent_class"]), outer)
            owner = entities[parent]["id"] if parent is not None and entities[parent]["name"] == e["parent_class"] else f"{e['file'] or ''}:{e['parent_class']}"
        elif outer is not None and entities[outer]["kind"] == "class":
            owner = entities[outer]["id"]
        elif e["kind"] == "class" and (j := nests.get((e["file"], e["name"]))) not in (None, i):
            parent, owner = j, entities[j]["id"]
        else:
            owner = e["file"]
        shape = e["kind"] + "(" + ",".join(sorted(o)) + ")"
        if e["id"] is not None:
            rows.append((i, parent, "entity", e["id"], owner, 0, e["name"], e["file"], e["kind"], _text(o.get("signature")), _text(o.get("docstring")), None, None, shape))
        for key, role in e["members"].items():
            child, _, form = role.partition(":")
            if child in ("parameters", "calls"):
                variant, v = child[:-1], o[key]
                if form == "map" and child == "parameters":
                    v = [{**x, "name": k} if isinstance(x, dict) else k for k, x in v.items()]
                for pos, x in enumerate(v if isinstance(v, list) else [v]):
                    name = _text(x.get("name")) if isinstance(x, dict) else _text(x)
                    if name is not None:
                        hint = x.get("type_hint") if isinstance(x, dict) else None
                        rows.append((node, i, variant, e["id"], e["id"], pos, name, e["file"], None, None, None, _text(hint), None, form))
                        node += 1
            elif child == "complexity":
                number = _integer(o[key].get("cyclomatic") if isinstance(o[key], dict) else o[key])
                if number is not None:
                    rows.append((node, i, "cyclomatic", e["id"], e["id"], 0, None, e["file"], None, None, None, None, number, form))
                    node += 1
    return rows


def _shred_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = ShapeAutomaton()
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    for pdf in batches:
        out: list[tuple] = []
        for dump_id, payload in zip(pdf["dump_id"], pdf["payload"]):
            rows = shred_payload(payload, automaton)
            if rows is None:
                out.append((dump_id, -1, None, "invalid", *[None] * 11))
            else:
                out.extend((dump_id, *r) for r in rows)
        frame = pd.DataFrame(out, columns=columns)
        for c in ("node", "parent_node", "pos"):
            frame[c] = frame[c].astype("Int32")
        for c in ("dump_id", "number"):
            frame[c] = frame[c].astype("Int64")
        yield frame


def shred_nodes(df: DataFrame, id_col: str = "dump_id", payload_col: str = "payload") -> DataFrame:
    """Every record found in the JSON payloads, as one tagged table (NODE_SCHEMA): a map without any shuffle.

    Uploads without an id give no row, null and invalid payloads one of variant 'invalid'; empty ones that are valid JSON give none. NaN and
    Infinity aren't JSON. Other columns of the input, however named, are left out. Null, empty and nameless children
    give no row but keep their place; a lone name or number is place 0. Repeated payloads give their rows again under
    their own id.
    """
    payloads = df.select(F.col(id_col).cast("bigint").alias("dump_id"), F.col(payload_col).cast("string").alias("payload"))
    return spread(payloads.where(F.col("dump_id").isNotNull())).mapInPandas(_shred_batches, NODE_SCHEMA)


def variant_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """Typed subtype tables of `shred_nodes`, each in a folder of its own: reading one reads neither the others' rows nor columns that it lacks."""
    routed = written(nodes, "variant")
    keys = ["dump_id", "node", "parent_node", "entity_id", "owner_id"]
    of = lambda v: routed.where(F.col("variant") == v)
    entity = of("entity")
    return {
        "functions": entity.where(F.col("entity_type") == "function").select(*keys, "name", "file", "signature", "docstring", "shape"),
        "classes": entity.where(F.col("entity_type") == "class").select(*keys, "name", "file", "docstring", "shape"),
        "parameters": of("parameter").select(*keys, "pos", "name", "type_hint", "shape"),
        "calls": of("call").select(*keys, "pos", "name", "shape"),
        "complexity": of("cyclomatic").select(*keys, F.col("number").alias("cyclomatic"), "shape"),
        "invalid": of("invalid").select("dump_id"),
    }


def child_links(tables: dict[str, DataFrame]) -> DataFrame:
    """(dump_id, owner_id, kind, child_pos, child) of all typed tables, without repeated rows."""
    row = lambda t, kind, pos, child: tables[t].select("dump_id", "owner_id", F.lit(kind).alias("kind"), pos.alias("child_pos"), child.alias("child"))
    zero = F.lit(0)
    parts = [
        row("functions", "entity", zero, F.col("entity_id")), row("classes", "entity", zero, F.col("entity_id")), row("parameters", "parameter", F.col("pos"), F.col("name")),
        row("calls", "call", F.col("pos"), F.col("name")), row("complexity", "cyclomatic", zero, F.col("cyclomatic").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
