"""Source files to entity rows: functions, classes, imports, variables, modules and code metrics.

Python is read with the standard library's syntax tree, Java and C++ with a small scanner of braces and
declarations. One file is one unit of work of a map over files; a file that can't be parsed gives one module row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

_S, _A = "string", "array<string>"
ENTITY_SCHEMA = (
    f"kind {_S}, unique_id {_S}, name {_S}, file {_S}, line int, end_line int, signature {_S}, parameters array<struct<name:string,type_hint:string,default_value:string,is_args:boolean,is_kwargs:boolean>>, "
    f"return_type {_S}, decorators {_A}, docstring {_S}, visibility {_S}, throws {_A}, is_async boolean, is_generator boolean, is_method boolean, is_static boolean, is_classmethod boolean, is_property boolean, parent_class {_S}, "
    f"cyclomatic int, cognitive int, lines_of_code int, calls {_A}, reads_globals {_A}, writes_globals {_A}, bases {_A}, metaclass {_S}, is_abstract boolean, is_dataclass boolean, is_protocol boolean, is_interface boolean, "
    f"methods {_A}, class_variables {_A}, instance_variables {_A}, nested_classes {_A}, module {_S}, imported_names {_A}, alias {_S}, is_relative boolean, is_star boolean, relative_level int, import_type {_S}, "
    f"is_constant boolean, total_lines int, code_lines int, comment_lines int, blank_lines int, parse_success boolean, has_await boolean, local_definitions {_A}"
)
_COLUMNS = [c.split(" ", 1)[0] for c in re.split(r", (?=\w+ \w)", ENTITY_SCHEMA)]
LANGUAGES = {".py": "python", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp"}
KINDS = ("function", "class", "variable", "import", "module")
_FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp)


def cyclomatic(node: ast.AST) -> int:
    """1 and one for each branch, loop, handler, with, assert, ternary, comprehension, its conditions and each boolean operator."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (*_FLOW, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        if isinstance(x, ast.comprehension):
            n += len(x.ifs)
    return n


def cognitive(node: ast.AST, name: str = "") -> int:
    """Branches weighted by nesting; else branches, boolean operators, jumps and recursion one each; nested definitions apart."""
    total, recursive = 0, False

    def walk(x: ast.AST, depth: int) -> None:
        nonlocal total, recursive
        for child in ast.iter_child_nodes(x):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            inner = depth
            if isinstance(child, (*_FLOW, ast.ExceptHandler, ast.With, ast.AsyncWith)):
                total += 1 + depth
                inner = depth + 1
                if isinstance(child, (ast.If, ast.For, ast.While)) and child.orelse and not (len(child.orelse) == 1 and isinstance(child.orelse[0], ast.If)):
                    total += 1
            elif isinstance(child, ast.BoolOp):
                total += len(child.values) - 1
            elif isinstance(child, (ast.Break, ast.Continue)):
                total += 1
            elif isinstance(child, ast.Call) and ast.unparse(child.func).split(".")[-1] == name:
                recursive = True
            walk(child, inner)

    walk(node, 0)
    return total + recursive


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function without those of nested definitions."""
    stack = list(ast.iter_child_nodes(node))
    while stack:
        x = stack.pop()
        yield x
        if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            stack.extend(ast.iter_child_nodes(x))


def _calls(node: ast.AST) -> list[str]:
    out: list[str] = []

    def walk(x: ast.AST) -> None:
        if isinstance(x, ast.Call):
            out.append(ast.unparse(x.func))
        for child in ast.iter_child_nodes(x):
            walk(child)

    for x in getattr(node, "body", []):
        walk(x)
    return out


def _parameters(a: ast.arguments) -> list[dict]:
    text = lambda x: ast.unparse(x) if x is not None else None
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [(p, d, False, False) for p, d in zip(plain, defaults)]
    if a.vararg:
        rows.append((a.vararg, None, True, False))
    rows += [(p, d, False, False) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        rows.append((a.kwarg, None, False, True))
    made = [{"name": p.arg, "type_hint": text(p.annotation), "default_value": text(d), "is_args": s, "is_kwargs": k} for p, d, s, k in rows]
    return [p for p in made if p["name"] not in ("self", "cls")]


def signature(name: str, parameters: list[dict], returns: str | None, is_async: bool = False) -> str:
    part = lambda p: ("*" if p["is_args"] else "**" if p["is_kwargs"] else "") + p["name"] + (f": {p['type_hint']}" if p["type_hint"] else "") + (f" = {p['default_value']}" if p["default_value"] else "")
    return f"{'async ' if is_async else ''}def {name}({', '.join(map(part, parameters))})" + (f" -> {returns}" if returns else "")


def global_use(fn: ast.AST, module_names: set[str]) -> tuple[list[str], list[str]]:
    """Names of module variables that a function reads and writes (declared global)."""
    declared = {n for x in _own(fn) if isinstance(x, ast.Global) for n in x.names}
    local = {x.id for x in _own(fn) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)} - declared
    local |= {a.arg for a in ast.walk(fn.args) if isinstance(a, ast.arg)}
    reads = {x.id for x in _own(fn) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)} & module_names - local
    writes = {x.id for x in _own(fn) if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del))} & declared
    return sorted(reads), sorted(writes)


def local_definitions(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Names that a function binds: parameters, targets of any kind, imports, nested definitions; not those declared global or nonlocal."""
    outer = {n for x in _own(fn) if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
    names = {a.arg for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs, fn.args.vararg, fn.args.kwarg] if a is not None}
    for x in _own(fn):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
            names.add(x.id)
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.add(x.name)
        elif isinstance(x, ast.ExceptHandler) and x.name:
            names.add(x.name)
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            names |= {(a.asname or a.name).split(".")[0] for a in x.names if a.name != "*"}
    return sorted(names - outer)


def line_counts(text: str, line_mark: str = "#", blocks: tuple[tuple[str, str], ...] = (('"""', '"""'), ("'''", "'''"))) -> tuple[int, int, int, int]:
    """(total, code, comment, blank) lines; block comments open at the start of a line and end with the mark of their kind."""
    code = comment = blank = 0
    inside = None
    lines = text.split("\n")
    for line in lines:
        s = line.strip()
        if not s:
            blank += 1
        elif inside:
            comment += 1
            inside = None if inside in s else inside
        elif block := next((b for b in blocks if s.startswith(b[0])), None):
            comment += 1
            inside = None if block[1] in s[len(block[0]) :] else block[1]
        elif s.startswith(line_mark):
            comment += 1
        else:
            code += 1
    return len(lines), code, comment, blank


def parse_python(path: str, text: str) -> list[dict]:
    counts = dict(zip(("total_lines", "code_lines", "comment_lines", "blank_lines"), line_counts(text)))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [{"kind": "module", "name": path, "file": path, "parse_success": False, **counts}]
    rows: list[dict] = []
    names = {t.id for x in tree.body if isinstance(x, (ast.Assign, ast.AnnAssign)) for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)}

    def function(x: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> None:
        deco = [ast.unparse(d).split("(")[0] for d in x.decorator_list]
        params, returns = _parameters(x.args), ast.unparse(x.returns) if x.returns else None
        reads, writes = global_use(x, names)
        is_async = isinstance(x, ast.AsyncFunctionDef)
        rows.append({
            "kind": "function", "unique_id": f"{path}:{parent}.{x.name}" if parent else f"{path}:{x.name}", "name": x.name, "file": path, "line": x.lineno, "end_line": x.end_lineno, "signature": signature(x.name, params, returns, is_async),
            "parameters": params, "return_type": returns, "decorators": deco, "docstring": ast.get_docstring(x), "is_async": is_async, "is_generator": any(isinstance(y, (ast.Yield, ast.YieldFrom)) for y in _own(x)),
            "is_method": parent is not None, "is_static": "staticmethod" in deco, "is_classmethod": "classmethod" in deco, "is_property": "property" in deco, "parent_class": parent, "cyclomatic": cyclomatic(x), "cognitive": cognitive(x, x.name),
            "lines_of_code": x.end_lineno - x.lineno + 1, "calls": _calls(x), "reads_globals": reads, "writes_globals": writes,
            "has_await": any(isinstance(y, (ast.Await, ast.AsyncFor, ast.AsyncWith)) for y in _own(x)), "local_definitions": local_definitions(x),
        })

    def klass(x: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in x.bases]
        meta = next((ast.unparse(k.value) for k in x.keywords if k.arg == "metaclass"), None)
        deco = [ast.unparse(d).split("(")[0] for d in x.decorator_list]
        methods = [m for m in x.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        init = next((m for m in methods if m.name == "__init__"), None)
        mine = [t.attr for s in ast.walk(init) if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"] if init else []
        variables = [t.id for s in x.body if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]
        nested = [c for c in x.body if isinstance(c, ast.ClassDef)]
        rows.append({
            "kind": "class", "unique_id": f"{path}:{x.name}", "name": x.name, "file": path, "line": x.lineno, "end_line": x.end_lineno, "decorators": deco, "docstring": ast.get_docstring(x), "bases": bases, "metaclass": meta,
            "is_abstract": any(b.split(".")[-1] == "ABC" for b in bases) or "ABCMeta" in (meta or ""), "is_dataclass": any(d.split(".")[-1] == "dataclass" for d in deco), "is_protocol": any(b.split("[")[0].split(".")[-1] == "Protocol" for b in bases),
            "is_interface": False, "methods": [m.name for m in methods], "class_variables": variables, "instance_variables": mine, "nested_classes": [c.name for c in nested],
        })
        for m in methods:
            function(m, x.name)
        for c in nested:
            klass(c)

    for x in tree.body:
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(x, None)
        elif isinstance(x, ast.ClassDef):
            klass(x)
        elif isinstance(x, (ast.Assign, ast.AnnAssign)):
            for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                if isinstance(t, ast.Name):
                    rows.append({"kind": "variable", "unique_id": f"{path}:{t.id}", "name": t.id, "file": path, "line": x.lineno, "is_constant": t.id.isupper(), "return_type": ast.unparse(x.annotation) if isinstance(x, ast.AnnAssign) else None})
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            rows += [{"kind": "import", "file": path, "line": x.lineno, "module": a.name, "imported_names": [], "alias": a.asname, "is_relative": False, "is_star": False, "relative_level": 0} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            rows.append({"kind": "import", "file": path, "line": x.lineno, "module": x.module, "imported_names": [a.name for a in x.names if a.name != "*"], "is_relative": x.level > 0, "is_star": any(a.name == "*" for a in x.names), "relative_level": x.level})
    exports = next(([e.value for e in x.value.elts if isinstance(e, ast.Constant)] for x in tree.body if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple))), None)
    rows.append({"kind": "module", "name": path, "file": path, "docstring": ast.get_docstring(tree), "imported_names": exports, "parse_success": True, **counts})
    return rows


_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_CLASS = {"java": re.compile(r"((?:@\w+(?:\([^)]*\))?\s+|public |private |protected |abstract |static |final |sealed )*)\b(class|interface|enum|record)\s+(\w+)(?:<[^{>]*>)?(?:\([^)]*\))?((?:\s+(?:extends|implements)\s+[^{]+)?)\s*\{"),
          "cpp": re.compile(r"((?:template\s*<[^>]*>\s*)?)\b(class|struct)\s+(\w+)(?:\s+final)?((?:\s*:\s*[^{;]+)?)\s*\{")}
_METHOD = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+)*)((?:(?:public|private|protected|static|final|abstract|synchronized|virtual|inline|explicit|constexpr|default|native|override)\s+)*)((?:[\w:<>,\[\]&*?~]+\s+)*?[\w:<>,\[\]&*?]*[&*\s]?)\b(~?[\w]+(?:::~?\w+)*)\s*\(([^(){};]*)\)\s*((?:const|noexcept|override|final)\s*)*(?:throws\s+([\w.,\s]+?))?\s*(?::[^{;]*)?\{")
_NOT_METHODS = frozenset("if for while switch catch return new else do try synchronized sizeof throw case".split())


def _blank_out(text: str) -> str:
    return _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _block_end(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                return i
    return len(text) - 1


def brace_complexity(body: str, name: str) -> tuple[int, int]:
    """(cyclomatic, cognitive) of a body in a brace language without comments and strings."""
    flow = len(re.findall(r"\b(?:if|for|while|case|catch)\b|\?(?=[^:;]*:)", body))
    logic = len(re.findall(r"&&|\|\|", body))
    total, depth, heads = logic, 0, []
    for m in re.finditer(r"\b(if|for|while|switch|catch|else|break|continue)\b|[{}]", body):
        t = m[0]
        if t == "{":
            depth += 1
        elif t == "}":
            depth = max(0, depth - 1)
        elif t in ("else", "break", "continue"):
            total += 1
        else:
            total += 1 + max(0, depth - 1)
    return 1 + flow + logic, total + bool(re.search(rf"\b{re.escape(name)}\s*\(", body))


_NAMESPACE = re.compile(r"\bnamespace\s+([\w:]+)\s*\{")
_ACCESS = re.compile(r"\b(public|private|protected)\s*:(?!:)")
_FIELD = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+)*)((?:(?:public|private|protected|static|final|volatile|transient|const|mutable|constexpr|inline)\s+)*)([\w:.<>,\[\]?&*\s]+?[\s&*>\]])(\w+)\s*(?:\[\s*\w*\s*\]\s*)?(?:=[^;]*)?$", re.S)
_DECLARED = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+)*)((?:(?:public|private|protected|static|final|abstract|synchronized|virtual|inline|explicit|constexpr|default|native|override)\s+)*)((?:[\w:<>,\[\]&*?~]+\s+)*?[\w:<>,\[\]&*?]*[&*\s]?)\b(~?\w+)\s*\(([^(){};]*)\)\s*((?:const|noexcept|override|final)\s*)*(?:throws\s+([\w.,\s]+?))?\s*(?:=\s*(?:0|default|delete))?$", re.S)


def _flat(body: str) -> str:
    """A class body without what is inside nested braces, which begin with a mark and end like statements do; places stay as they are."""
    out, depth = [], 0
    for c in body:
        if c == "{":
            depth += 1
        out.append(c if depth == 0 or c == "\n" else "\0" if c == "{" and depth == 1 else ";" if c == "}" and depth == 1 else " ")
        if c == "}":
            depth -= 1
    return "".join(out)


def _brace_parameters(text: str) -> list[dict]:
    params = []
    for p in re.split(r",(?![^<]*>)", text):
        q = re.sub(r"\bfinal\b|@\w+", "", p).strip()
        if q and q != "void" and (w := re.match(r"^(.*?)([\w]+)(\[\])?\s*(?:=\s*(.+))?$", q)):
            hint = w[1].strip()
            params.append({"name": w[2], "type_hint": hint or None, "default_value": w[4], "is_args": "..." in hint, "is_kwargs": False})
    return params


def parse_braces(path: str, text: str, language: str) -> list[dict]:
    """Java or C++ by declarations and braces: classes with fields and nesting, methods with and without a body, imports, the file."""
    plain = _blank_out(text)
    line_of = lambda i: plain.count("\n", 0, i) + 1
    rows: list[dict] = []
    spaces = [(m.start(), _block_end(plain, m.end() - 1), m[1]) for m in _NAMESPACE.finditer(plain)] if language == "cpp" else []
    space_of = lambda i: "::".join(n for a, b, n in spaces if a < i < b)
    prefixed = lambda i, name: f"{s}::{name}" if (s := space_of(i)) else name
    classes = []
    for m in _CLASS[language].finditer(plain):
        end = _block_end(plain, m.end() - 1)
        heritage = re.sub(r"\b(?:extends|implements|public|private|protected|virtual)\b|^\s*:", ",", m[4] or "")
        bases = [b.strip() for b in re.split(r",(?![^<]*>)", heritage) if b.strip()]
        decorators = re.findall(r"@(\w+)", m[1] or "")
        modifiers = re.findall(r"\b(public|protected|private)\b", m[1] or "")
        classes.append((m.start(), end, m[3], m[2], m.end()))
        rows.append({"kind": "class", "unique_id": f"{path}:{prefixed(m.start(), m[3])}", "name": m[3], "file": path, "line": line_of(m.start(2)), "end_line": line_of(end), "bases": bases, "decorators": decorators, "is_abstract": "abstract" in (m[1] or "") or m[2] == "interface",
                     "is_interface": m[2] == "interface", "is_dataclass": m[2] in ("enum", "struct", "record"), "is_protocol": False, "visibility": modifiers[0] if modifiers else None, "methods": [], "nested_classes": [], "class_variables": [], "instance_variables": []})
    by_class = dict(zip(classes, rows))
    by_name = {r["name"]: r for r in rows}
    inside = lambda i: max((c for c in classes if c[0] < i < c[1]), key=lambda c: c[0], default=None)
    for c, row in by_class.items():
        if outer := inside(c[0]):
            by_class[outer]["nested_classes"].append(row["name"])

    def visibility(at: int, owner: tuple | None, modifiers: list[str]) -> str | None:
        named = next((x for x in modifiers if x in ("public", "private", "protected")), None)
        if named or owner is None or language != "cpp":
            return named or ("public" if owner is not None and owner[3] == "interface" else None)
        labels = [m[1] for m in _ACCESS.finditer(_flat(plain[owner[4] : owner[1]])[: at - owner[4]])]
        return labels[-1] if labels else "public" if owner[3] == "struct" else "private"

    def function(m: re.Match, start: int, at: int, end: int, body: str) -> None:
        short = m[4].split("::")[-1]
        owner = inside(start)
        parent = m[4].split("::")[-2] if "::" in m[4] else owner[2] if owner else None
        cyc, cog = brace_complexity(body, short) if body else (1, 0)
        modifiers = m[2].split()
        calls = [c for c in re.findall(r"((?:[\w]+(?:\.|::|->))*[\w]+)\s*\(", body) if c.split(".")[-1] not in _NOT_METHODS]
        rows.append({"kind": "function", "unique_id": f"{path}:{prefixed(start, f'{parent}.{short}' if parent else short)}", "name": short, "file": path, "line": line_of(start), "end_line": line_of(end), "signature": " ".join(plain[at:start].split() + [" ".join(m[0][m.start(4) - m.start() :].rstrip("{").split())]),
                     "parameters": _brace_parameters(m[5]), "return_type": m[3].strip() or None, "decorators": re.findall(r"@(\w+)", m[1]) + modifiers, "visibility": visibility(start, owner, modifiers), "throws": [x.strip() for x in (m[7] or "").split(",") if x.strip()], "is_async": False, "is_generator": False,
                     "is_method": parent is not None, "is_static": "static" in modifiers, "is_classmethod": False, "is_property": False, "parent_class": parent, "cyclomatic": cyc, "cognitive": cog, "lines_of_code": line_of(end) - line_of(start) + 1, "calls": calls})
        if parent in by_name:
            by_name[parent]["methods"].append(short)

    for m in _METHOD.finditer(plain):
        if m[4].split("::")[-1] in _NOT_METHODS or m[3].strip().split(" ")[-1:] in (["new"], ["return"], ["else"]):
            continue
        end = _block_end(plain, m.end() - 1)
        function(m, m.start(4), m.start(2), end, plain[m.end() - 1 : end + 1])
    for c, row in by_class.items():
        # What stands in the class itself: methods without a body, and fields.
        flat = _ACCESS.sub(lambda x: " " * (len(x[0]) - 1) + ";", _flat(plain[c[4] : c[1]]))
        if c[3] == "enum":  # up to the first semicolon stand its constants
            constants = flat.split(";", 1)[0]
            flat = " " * len(constants) + flat[len(constants) :]
        at = c[4]
        for statement in flat.split(";"):
            start, at = at + len(statement) - len(statement.lstrip()), at + len(statement) + 1
            t = statement.strip()
            if not t or "\0" in t and "=" not in t.split("\0")[0]:
                continue  # something with a body of its own
            t = t.split("\0")[0].rstrip()
            if (m := _DECLARED.fullmatch(t)) and m[4] not in _NOT_METHODS and m[3].strip() not in ("new", "return", "else", "throw") and (m[3].strip() or m[2] or m[4].lstrip("~") == c[2]):
                function(m, start + m.start(4), start + m.start(2), start + len(t), "")
            elif "(" not in t.split("=")[0] and (declared := [x for x in re.split(r",(?![^<(\[]*[>)\]])", t)]) and (m := _FIELD.fullmatch(declared[0].strip())) and m[3].split()[0] not in ("return", "using", "typedef", "friend", "package", "import", "case"):
                modifiers = m[2].split()
                fixed, shared = bool({"final", "const", "constexpr"} & {*modifiers, *m[3].split()}), "static" in modifiers
                for name in [m[4], *(n[1] for x in declared[1:] if (n := re.match(r"\s*[*&]*\s*(\w+)", x)))]:
                    row["class_variables" if shared else "instance_variables"].append(name)
                    rows.append({"kind": "variable", "unique_id": f"{path}:{prefixed(start, f'{c[2]}.{name}')}", "name": name, "file": path, "line": line_of(start), "return_type": m[3].strip(), "is_constant": fixed, "is_static": shared, "parent_class": c[2], "visibility": visibility(start, c, modifiers), "decorators": re.findall(r"@(\w+)", m[1])})
    if language == "java":
        for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+?)(?:\.(\*|\w+))\s*;", plain, re.M):
            rows.append({"kind": "import", "file": path, "line": line_of(m.start(2)), "module": m[2], "imported_names": [] if m[3] == "*" else [m[3]], "is_star": m[3] == "*", "is_relative": False, "relative_level": 0, "import_type": "static" if m[1] else "import"})
    else:
        for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*([<"])([^>"]+)[>"]', text, re.M):
            rows.append({"kind": "import", "file": path, "line": text.count("\n", 0, m.start()) + 1, "module": m[2], "imported_names": [], "is_relative": m[1] == '"', "is_star": False, "relative_level": 0, "import_type": "include"})
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", plain, re.M)
    counts = dict(zip(("total_lines", "code_lines", "comment_lines", "blank_lines"), line_counts(text, "//", (("/*", "*/"),))))
    balanced = all(plain.count(a) == plain.count(b) for a, b in ("{}", "()", "[]"))
    rows.append({"kind": "module", "name": path, "file": path, "docstring": package[1] if package else None, "parse_success": balanced, **counts})
    return rows


def parse_file(path: str, text: str | None) -> list[dict]:
    """Rows of one file by its extension; what has no known extension is read as Python."""
    language = LANGUAGES.get("." + path.rsplit(".", 1)[-1].lower(), "python")
    return parse_python(path, text or "") if language == "python" else parse_braces(path, text or "", language)


def load_order(entities: DataFrame, path: str = "file") -> DataFrame:
    """Functions, then classes, of each file in the order of files and lines, numbered from 0 as they are loaded: what look-ups by name break ties with.

    The number is a sum over ranges of files: no task sees them all.
    """
    e = entities.where(F.col("kind").isin("function", "class")).withColumn("_k", F.when(F.col("kind") == "function", 0).otherwise(1))
    w = Window.partitionBy(path).orderBy("_k", "line", "unique_id")
    placed = e.withColumn("_i", F.row_number().over(w) - 1)
    counts = placed.groupBy(path).agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(path).sortWithinPartitions(path).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged)
    starts = ranged.groupBy("_p").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    within = ranged.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(path).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = within.join(F.broadcast(starts), "_p").select(path, (F.col("_in") + F.col("_before")).alias("_first"))
    return placed.join(first, path).withColumn("ordinal", F.col("_first") + F.col("_i")).drop("_k", "_i", "_first")


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, content) -> rows of ENTITY_SCHEMA, of a file in the order of KINDS: a map over whole files. Null paths give no row, null contents an empty module."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["content"]) for r in sorted(parse_file(p, t), key=lambda r: KINDS.index(r["kind"]))]
            frame = pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in rows], columns=_COLUMNS, dtype=object)
            for c in ("line", "end_line", "cyclomatic", "cognitive", "lines_of_code", "relative_level", "total_lines", "code_lines", "comment_lines", "blank_lines"):
                frame[c] = frame[c].astype("Int32")
            for c in _COLUMNS:
                if c.startswith("is_") or c in ("parse_success", "has_await"):
                    frame[c] = frame[c].astype("boolean")
            yield frame

    return files.where(F.col("path").isNotNull()).select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, ENTITY_SCHEMA)
