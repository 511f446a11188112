"""Facts of one source or config file: small helpers that run inside mapInPandas."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

from spanlake.functions.lexer import code_only, pairs, unit_end

Unit = dict

#: File ending -> function of (source, path, module) that yields units.
EXTRACTORS: dict[str, Callable[[str, str, str], Iterator[Unit]]] = {}

_HTTP = ("get", "post", "put", "delete", "patch", "head", "options")


def _unit(name: str, qualified: str, kind: str, start: int, end: int, **more) -> Unit:
    return {"name": name, "qualified_name": qualified, "unit_type": kind, "start_line": start, "end_line": end, "signature": "", "docstring": "", "body_text": "", "imports": [], "calls": [], "route_path": None} | more


def _routes(node) -> Iterator[str]:
    """`METHOD /path` of each of a function's decorators that names one, in order; `route` takes its first method, or GET."""
    for call in (d for d in node.decorator_list if isinstance(d, ast.Call)):
        verb = getattr(call.func, "attr", None)
        path = call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) else None
        if path is None or verb not in (*_HTTP, "route"):
            continue
        if verb == "route":
            values = {k.arg: k.value for k in call.keywords}
            verb = next((m.value for m in getattr(values.get("methods"), "elts", ()) if isinstance(m, ast.Constant)), "get")
        yield f"{verb.upper()} {path}"


def python_units(source: str, path: str, module: str) -> Iterator[Unit]:
    """Functions and classes of Python source; notebook magics are neutralised, a syntax error gives none."""
    source = re.sub(r"(?m)^(\s*)[!%].*$", r"\1pass", source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    lines = source.split("\n")
    imports = [f"{n.module or ''}.{a.name}" if isinstance(n, ast.ImportFrom) else a.name for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names]
    stack: list[tuple[ast.AST, str, bool]] = [(tree, module, False)]
    while stack:
        parent, prefix, in_class = stack.pop()
        for node in reversed(list(ast.iter_child_nodes(parent))):
            if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                stack.append((node, prefix, in_class))
                continue
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "method" if in_class else "function"
            head = "class" if is_class else "async def" if kind == "async_function" else "def"
            inner = ", ".join(map(ast.unparse, node.bases)) if is_class else ast.unparse(node.args)
            calls = [c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)]
            name = f"{prefix}.{node.name}"
            yield _unit(
                node.name, name, kind, node.lineno, node.end_lineno or node.lineno, signature=f"{head} {node.name}({inner})", docstring=ast.get_docstring(node) or "",
                body_text="\n".join(lines[node.lineno - 1 : node.end_lineno]), imports=imports, calls=list(dict.fromkeys(calls)), route_path=None if is_class else next(_routes(node), None),
            )
            stack.append((node, name, is_class))


# What begins a unit, by language: kind and a regex with its name and, if it has any, parameters.
_HEADS = {
    "javascript": (
        ("function", r"^[ \t]*+(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
        ("function", r"^[ \t]*+(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:<[^>]*>\s*)?\(([^)]*)\)[^=\n]*=>"),
        ("function", r"^[ \t]*+(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function\b\s*\*?\s*\w*\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
        ("class", r"^[ \t]*+(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^[ \t]*+(?:export\s+)?interface\s+(\w+)"),
        ("type_alias", r"^[ \t]*+(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*="),
        ("enum", r"^[ \t]*+(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
        ("namespace", r"^[ \t]*+(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)\s*\{"),
        ("method", r"^[ \t]++(?:(?:public|private|protected|static|override|readonly)\s+)*(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*(?:<[^>(]*>)?\s*\(([^)]*)\)\s*(?::[^{\n]*)?\{"),
    ),
    "go": (
        ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\(([^)]*)\)"),
        ("function", r"^func\s+(\w+)\s*(?:\[[^\]]*\])?\s*\(([^)]*)\)"),
        ("class", r"^type\s+(\w+)\s*(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^type\s+(\w+)\s*(?:\[[^\]]*\])?\s+interface\b"),
    ),
    "java": (
        ("class", r"^[^\S\n]*+(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|record)\s+(\w+)"),
        ("interface", r"^[^\S\n]*+(?:public\s+)?interface\s+(\w+)"),
        ("enum", r"^[^\S\n]*+(?:public\s+)?enum\s+(\w+)"),
        ("method", r"^[ \t]++(?:(?:public|private|protected|static|final|synchronized|abstract|default)\s+)*(?!return\b|new\b|throw\b|else\b)[\w.]+(?:<[^>(]*>)?(?:\[\])?\s+(\w+)\s*\(([^)]*)\)\s*(?:throws[^{]*)?\{"),
    ),
}


# Decorators of methods that make them routes; one without a method of its own is a GET.
_ROUTE_DECORATOR = re.compile(r"@(Get|Post|Put|Delete|Patch|Head|Options|All|RequestMapping)\s*\(\s*['\"](.+?)['\"]")
_ABOVE = re.compile(r"(?:/\*\*((?:[^*]|\*(?!/))*)\*/|((?:^[ \t]*//[^\n]*\n)+))\s*((?:@\w+[^\n]*\n\s*)*)\Z|((?:@\w+[^\n]*\n\s*)+)\Z", re.MULTILINE)


def brace_units(language: str) -> Callable[[str, str, str], Iterator[Unit]]:
    """An extractor for a language of brace blocks: units by what begins them, with the comment above as docstring.

    Heads and blocks are looked for in the code alone (`lexer.code_only`), so comments, strings, templates and
    regular expressions neither begin nor end units.
    """

    def extract(source: str, path: str, module: str) -> Iterator[Unit]:
        code = code_only(source, language)
        closed = pairs(code)
        lines = [m.end() for m in re.finditer("\n", source)]
        line = lambda at: bisect.bisect_right(lines, at) + 1
        found = [(m.start(), kind, m) for kind, p in _HEADS[language] for m in re.compile(p, re.MULTILINE).finditer(code)]
        outer: list[tuple[int, str, str]] = []
        seen = set()
        for begin, kind, m in sorted(found, key=lambda f: (f[0], f[1])):
            indented = len(m[0]) > len(m[0].lstrip(" \t"))
            begin += len(m[0]) - len(m[0].lstrip())
            if begin in seen:
                continue
            while outer and outer[-1][0] <= begin:
                outer.pop()
            holder = outer[-1][2] if outer else ""
            if kind == "method" and language != "go" and holder not in ("class", "interface", "enum"):
                continue
            if language == "javascript" and kind != "method" and indented and holder != "namespace":
                continue
            seen.add(begin)
            end = unit_end(code, closed, m.end() - (m[0].endswith("{")), kind in ("class", "interface", "enum", "namespace"))
            prefix = outer[-1][1] if outer else module
            name = f"{prefix}.{m[1]}"
            if kind in ("class", "interface", "enum", "namespace"):
                outer.append((end, name, kind))
            above = _ABOVE.search(source[max(0, begin - 2000) : begin])
            doc = re.sub(r"(?m)^[ \t]*(?:\*|//)[ \t]?", "", (above[1] or above[2] or "")).strip() if above else ""
            route = _ROUTE_DECORATOR.search((above[3] or above[4] or "")) if above and language == "javascript" and kind == "method" else None
            verb = {"REQUESTMAPPING": "GET"}.get(route[1].upper(), route[1].upper()) if route else ""
            yield _unit(m[1], name, kind, line(begin), line(max(begin, end - 1)), signature=source[begin : m.end()].rstrip(" {").strip(), docstring=doc, body_text=source[begin:end], route_path=f"{verb} {route[2]}" if route else None)

    return extract


EXTRACTORS |= {".py": python_units, ".go": brace_units("go"), ".java": brace_units("java")}
EXTRACTORS |= {e: brace_units("javascript") for e in (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")}


def router_prefixes(source: str) -> list[tuple[str, str]]:
    """(target module, prefix) of each include_router call with a prefix in Python source."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    known = {a.asname or a.name: f"{n.module}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module for a in n.names}
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "include_router" and n.args:
            prefix = next((k.value.value for k in n.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), "")
            target = n.args[0].value if isinstance(n.args[0], ast.Attribute) else n.args[0]
            if prefix and isinstance(target, ast.Name):
                out.append((known.get(target.id, target.id).removesuffix(".router"), prefix))
    return out


def select_names(body: str) -> list[str]:
    """Aliases, or last names, of a SELECT list; commas inside parentheses don't split."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(body[last:i])
            last = i + 1
    names = (re.search(r"(?:\bAS\s+|^\s*|[\s.])(\w+)\s*$", p, re.IGNORECASE) for p in [*parts, body[last:]])
    return [m[1] for m in names if m]


def nested(content: str) -> dict:
    """Block mappings and lists of a YAML text by indentation; scalars as text without quotes."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    waiting: tuple[dict, str] | None = None
    for line in content.split("\n"):
        text = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not text.strip() or text.strip() == "---":
            continue
        indent, text = len(text) - len(text.lstrip()), text.strip()
        item = text.startswith("- ")
        while len(stack) > 1 and (indent < stack[-1][0] or (indent == stack[-1][0] and isinstance(stack[-1][1], list) and not item)):
            stack.pop()
        if waiting and (indent > stack[-1][0] or item):
            made: dict | list = [] if item else {}
            waiting[0][waiting[1]] = made
            stack.append((indent, made))
        waiting = None
        top = stack[-1][1]
        if item and isinstance(top, list):
            top.append(text[2:].strip().strip("'\""))
        elif isinstance(top, dict) and (m := re.match(r"['\"]?([^:'\"]+)['\"]?\s*:(?:\s+(.*))?$", text)):
            top[m[1]] = (m[2] or "").strip("'\"")
            waiting = (top, m[1]) if not m[2] else None
    return root


# Keys that make a mapping a connection, and words that make it a credential.
_CONNECTION = {"host", "port", "database", "user", "password", "type", "method", "project", "dataset", "connection"}
_CREDENTIAL = ("api_key", "secret", "password", "token")


def yaml_elements(content: str) -> Iterator[tuple[str, str, dict]]:
    """(name, type, properties) of compose services, dbt profiles, soda's cloud keys and connections one level deep."""
    data = nested(content)
    flat = lambda d: {k: str(v) for k, v in d.items() if not isinstance(v, dict | list)}
    services = data.get("services")
    for name, conf in services.items() if isinstance(services, dict) else ():
        conf = conf if isinstance(conf, dict) else {}
        env = conf.get("environment", {})
        env = dict(e.split("=", 1) for e in env if "=" in e) if isinstance(env, list) else env if isinstance(env, dict) else {}
        listed = {k: ", ".join(v) if isinstance(v, list) else str(v) for k in ("image", "ports", "restart", "volumes") if (v := conf.get(k))}
        yield name, "service", listed | env
    if isinstance(data.get("soda_cloud"), dict):
        yield "soda_cloud", "credential", flat(data["soda_cloud"])
    for name, conf in data.items():
        if name == "soda_cloud":
            continue
        inner = [(name, conf)] if isinstance(conf, dict) else []
        inner += [(f"{name}.{k}", v) for k, v in conf.items() if isinstance(v, dict)] if isinstance(conf, dict) and name != "services" else []
        for title, d in inner:
            if title != "services" and _CONNECTION & {k.lower() for k in d}:
                yield title, "credential" if any(w in str(d).lower() for w in _CREDENTIAL) else "connection", flat(d)
        outputs = conf.get("outputs") if isinstance(conf, dict) else None
        for target, d in outputs.items() if isinstance(outputs, dict) else ():
            if isinstance(d, dict):
                yield f"{name}.{target}", "dbt_profile", flat(d)


def toml_elements(content: str) -> Iterator[tuple[str, str, dict]]:
    """(name, type, properties) of each section with properties."""
    section, props = "root", {}
    for line in [*map(str.strip, content.split("\n")), "["]:
        if line.startswith("["):
            if props:
                yield f"toml:{section}", "setting", props
            section, props = line.strip("[] "), {}
        elif "=" in line and not line.startswith("#"):
            key, _, value = line.partition("=")
            props[key.strip()] = value.strip().strip("'\"")
