"""Facts of source files: functions, calls, assignments, references, imports,
globals.

Python is read by its own parser, C and C++ by a tokenizer that follows braces
and parentheses; macros and templates may escape the latter.  A file is a row,
and its facts are arrays of the row, so nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, language string, parse_has_errors boolean, branch_count long, "
    "functions array<struct<name:string, start_line:int, end_line:int, parameters:array<string>>>, "
    "calls array<struct<name:string, line:int, expression:string>>, "
    "assignments array<struct<targets:array<string>, value:string, line:int>>, "
    "references array<struct<text:string, line:int>>, imports array<struct<name:string, line:int>>, "
    "globals array<struct<names:array<string>, line:int>>, dangerous_calls array<struct<name:string, line:int>>"
)
#: Calls that are listed as dangerous, by language.
DANGEROUS_C = {"strcpy", "strcat", "sprintf", "gets", "scanf", "sscanf", "memcpy", "memmove", "system", "popen", "printf"}
DANGEROUS = {
    "python": {"eval", "exec", "compile", "pickle.loads", "subprocess.call", "subprocess.run", "os.system", "os.popen", "yaml.load", "render_template_string", "input", "os.getenv"},
    "c": DANGEROUS_C,
    "cpp": DANGEROUS_C,
}


def empty(path: str, language: str | None) -> dict:
    return {"path": path, "language": language, "parse_has_errors": False, "branch_count": 0, "functions": [], "calls": [], "assignments": [], "references": [], "imports": [], "globals": [], "dangerous_calls": []}


class _Python(ast.NodeVisitor):
    def __init__(self, text: str, out: dict):
        self.text, self.out, self.depth = text, out, 0

    def source(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def visit_FunctionDef(self, node) -> None:
        a = node.args
        names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]
        self.out["functions"].append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "parameters": names})
        self.depth += 1
        self.generic_visit(node)
        self.depth -= 1

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        self.out["calls"].append({"name": self.source(node.func), "line": node.lineno, "expression": self.source(node)})
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.out["references"].append({"text": self.source(node), "line": node.lineno})
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        module = getattr(node, "module", None)
        for x in node.names:
            self.out["imports"].append({"name": f"{module}.{x.name}" if module else x.name, "line": node.lineno})

    visit_ImportFrom = visit_Import

    def bind(self, node, targets: list[ast.AST], value: ast.AST | None) -> None:
        names = [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        if names and value is not None:
            self.out["assignments"].append({"targets": names, "value": self.source(value), "line": node.lineno})
            if not self.depth:
                self.out["globals"].append({"names": names, "line": node.lineno})
        self.generic_visit(node)

    def visit_Assign(self, node) -> None:
        self.bind(node, node.targets, node.value)

    def visit_AnnAssign(self, node) -> None:
        self.bind(node, [node.target], node.value)

    visit_AugAssign = visit_NamedExpr = visit_AnnAssign

    def visit_For(self, node) -> None:
        self.out["branch_count"] += 1
        self.bind(node, [node.target], node.iter)

    def visit_With(self, node) -> None:
        for item in node.items:
            if item.optional_vars is not None:
                self.bind(node, [item.optional_vars], item.context_expr)
                return
        self.generic_visit(node)

    visit_AsyncFor = visit_For

    def visit_While(self, node) -> None:
        self.out["branch_count"] += 1
        self.generic_visit(node)

    visit_Try = visit_TryStar = visit_Match = visit_While

    def visit_If(self, node) -> None:
        """An elif is a part of the statement before it."""
        line = self.text.splitlines()[node.lineno - 1].encode()[node.col_offset :]
        self.out["branch_count"] += not line.startswith(b"elif")
        self.generic_visit(node)


_C_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_C_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_C_FUNCTION = re.compile(r"(?m)^[A-Za-z_][\w\s\*&:<>,~]*?\b([A-Za-z_~][\w:~]*)\s*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const\s*)?(?:noexcept\s*)?\{")
_C_CALL = re.compile(r"\b([A-Za-z_]\w*(?:(?:::|\.|->)[A-Za-z_]\w*)*)\s*\(")
_C_ASSIGN = re.compile(r"(?:^|[;{}(,])\s*(?:[A-Za-z_][\w:<>]*[\s\*&]+)*\*?([A-Za-z_]\w*)(?:\s*\[[^\]]*\])*\s*[-+*/|&^%]?=(?!=)\s*([^;]+?)\s*(?=;)", re.M)
_C_INCLUDE = re.compile(r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
_C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "catch", "defined"}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _closing(text: str, at: int, opens: str, closes: str) -> int:
    """Place after the bracket that closes the one at a place."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] in opens:
            depth += 1
        elif text[k] in closes:
            depth -= 1
            if not depth:
                return k + 1
    return len(text)


def c_facts(text: str, out: dict) -> None:
    code = _C_NOISE.sub(_blank, text)
    bare = _C_STRING.sub(lambda m: m[0][0] + re.sub(r"[^\n]", "_", m[0][1:-1]) + m[0][-1], code)
    lines = [0] + [m.end() for m in re.finditer("\n", bare)]
    import bisect

    line_of = lambda k: bisect.bisect_right(lines, k)
    out["parse_has_errors"] = bare.count("{") != bare.count("}")
    for m in _C_INCLUDE.finditer(code):
        out["imports"].append({"name": m[1], "line": line_of(m.start(1))})
    spans = []
    for m in _C_FUNCTION.finditer(bare):
        if m[1].split("::")[-1] in _C_WORDS:
            continue
        end = _closing(bare, m.end() - 1, "{", "}")
        names = [x[-1] for x in (re.findall(r"[A-Za-z_]\w*", p) for p in m[2].split(",")) if len(x) > 1]
        out["functions"].append({"name": m[1], "start_line": line_of(m.start()), "end_line": line_of(end - 1), "parameters": names})
        spans.append((m.start(), end, m.start(1)))
    heads = {s[2] for s in spans}
    for m in _C_CALL.finditer(bare):
        if m[1] in _C_WORDS or m.start(1) in heads or not any(a < m.start() < b for a, b, _ in spans):
            continue
        end = _closing(bare, m.end() - 1, "(", ")")
        out["calls"].append({"name": m[1].replace("->", "."), "line": line_of(m.start()), "expression": code[m.start() : end]})
    for m in _C_ASSIGN.finditer(bare):
        fact = {"targets": [m[1]], "value": code[m.start(2) : m.end(2)], "line": line_of(m.start(1))}
        if any(a < m.start(1) < b for a, b, _ in spans):
            out["assignments"].append(fact)
        else:
            out["globals"].append({"names": [m[1]], "line": fact["line"]})
    for m in re.finditer(r"\bargv\b(?:\s*\[[^\]]*\])?", bare):
        out["references"].append({"text": code[m.start() : m.end()], "line": line_of(m.start())})
    plain = re.sub(r"(?m)^[ \t]*#(?:\\\n|[^\n])*", "", bare)
    words = r"if|for|while|switch|try" if out["language"] == "cpp" else r"if|for|while|switch"
    ranges = len(re.findall(r"\bfor\s*\([^;()]*(?<!:):(?!:)[^;]*?\)", plain)) if out["language"] == "cpp" else 0
    # the while that ends a do stands for the do
    out["branch_count"] = len(re.findall(rf"\b(?:{words})\b", plain)) - ranges


def file_facts(path: str, language: str | None, text: str | None) -> dict:
    out = empty(path, language)
    if language == "python":
        try:
            _Python(text or "", out).visit(ast.parse(text or ""))
        except (SyntaxError, ValueError, RecursionError):
            out["parse_has_errors"] = True
    elif language in ("c", "cpp"):
        c_facts(text or "", out)
    out["dangerous_calls"] = [{"name": c["name"], "line": c["line"]} for c in out["calls"] if {c["name"], c["name"].split("::")[-1]} & DANGEROUS.get(language or "", set())]
    return out


def facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, text)."""
    names = [f.split()[0] for f in re.split(r", (?=\w+ (?:string|boolean|long|array))", SCHEMA)]

    def run(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([file_facts(*r) for r in zip(pdf["path"], pdf["language"], pdf["text"])], columns=names)

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)
