"""Symbols of source files: Python by its own grammar, Rust and TypeScript or JavaScript by lexers that know strings and comments.

A file that has no symbol, cannot be parsed or has no parser falls back to fixed windows in chunk_files, so no file is lost.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .chunkers import fixed_windows

SYMBOLS = (
    "path string, seq int, name string, qualified_name string, kind string, visibility string, line_start int, line_end int, text string, parent string, doc_comment string,"
    " parameters array<struct<name:string,type_annotation:string,default_value:string>>, return_type string, modifiers array<string>"
)


def _symbol(name: str, kind: str, visibility: str | None, first: int, last: int, text: str, parent: str | None = None, doc: str | None = None, parameters: list | None = None, returns: str | None = None, modifiers: list | None = None) -> dict:
    return {
        "name": name, "qualified_name": f"{parent}::{name}" if parent else name, "kind": kind, "visibility": visibility, "line_start": first, "line_end": last, "text": text,
        "parent": parent, "doc_comment": doc, "parameters": parameters, "return_type": returns, "modifiers": modifiers,
    }


def python_symbols(source: str) -> list[dict]:
    """Functions and classes at the top, and methods of classes; nested functions are part of theirs."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def visit(body: list, parent: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                out.append(_symbol(node.name, "class", "public", node.lineno, node.end_lineno, ast.get_source_segment(source, node) or "", parent, ast.get_docstring(node)))
                visit(node.body, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                plain = [*a.posonlyargs, *a.args]
                values = [None] * (len(plain) - len(a.defaults)) + [ast.unparse(d) for d in a.defaults]
                # A parameter with both a type and a default is not listed, nor are starred ones.
                listed = [
                    {"name": p.arg, "type_annotation": ast.unparse(p.annotation) if p.annotation else None, "default_value": v}
                    for p, v in zip(plain, values, strict=True) if not (p.annotation and v is not None)
                ]
                marks = ["async"] * isinstance(node, ast.AsyncFunctionDef) + [f"@{ast.unparse(d)}" for d in node.decorator_list]
                seen = "private" if node.name.startswith("_") else "public"
                returns = ast.unparse(node.returns) if node.returns else None
                out.append(_symbol(node.name, "method" if parent else "function", seen, node.lineno, node.end_lineno, ast.get_source_segment(source, node) or "", parent, ast.get_docstring(node), listed, returns, marks))

    visit(tree.body, None)
    return out


_QUIET = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'(?=[\s,;:)\]}+])""", re.S)


def _blanked(source: str) -> str:
    """source with the insides of strings and comments as spaces, so that braces and words in them do not count."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _closing(code: str, at: int, pair: str) -> int:
    """Place after the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(code)


def _split_list(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += c in "([{<"
        depth -= c in ")]}" or (c == ">" and text[k - 1 : k] not in "-=")
        if c == "," and depth <= 0:
            parts.append(text[last:k])
            last = k + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


_RUST = re.compile(
    r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?(?P<mods>(?:(?:default|async|unsafe|const|extern(?:\s+\"[^\"]*\"|\s+)?)\s+)*)\b(?:(?P<kind>fn|struct|enum|trait|mod)\s+(?P<name>\w+)"
    r"|(?P<value>const|static)\s+(?:mut\s+)?(?P<vname>\w+)\s*:|impl\b(?P<impl>[^{;]*)(?=\{))"
)


def rust_symbols(source: str) -> list[dict]:
    """Functions, structs, enums, traits, constants; impl blocks give their type as parent, modules are gone into."""
    code, lines, out = _blanked(source), source.split("\n"), []

    def visit(lo: int, hi: int, parent: str | None) -> None:
        at = lo
        while m := _RUST.search(code, at, hi):
            brace, semi = code.find("{", m.end(), hi), code.find(";", m.end(), hi)
            body = brace if brace >= 0 and (semi < 0 or brace < semi) else -1
            if m["value"]:
                body = -1
            end = _closing(code, body, "{}") if body >= 0 else (semi + 1 if semi >= 0 else hi)
            start = m.start()
            first, last = source.count("\n", 0, start) + 1, source.count("\n", 0, max(start, end - 1)) + 1
            vis = (m["vis"] or "").replace(" ", "").strip()
            seen = "private" if not vis else "internal" if vis == "pub(crate)" else "public"
            doc, k = [], first - 2
            while k >= 0 and (lines[k].strip().startswith("///") or not lines[k].strip()):
                if lines[k].strip():
                    doc.insert(0, lines[k].strip()[3:].strip())
                k -= 1
            note, text = "\n".join(doc) or None, source[start:end]
            if m["impl"] is not None:
                kind = re.sub(r"^\s*<.*?>\s+", "", m["impl"]).split(" where ")[0]
                visit(body + 1, end - 1, kind.split(" for ")[-1].strip())
            elif m["kind"] == "mod":
                if body >= 0:
                    visit(body + 1, end - 1, parent)
            elif m["kind"] == "fn":
                par = code.find("(", m.end())
                close = _closing(code, par, "()")
                listed = []
                for p in _split_list(source[par + 1 : close - 1]):
                    if ":" in p and not re.match(r"&?\s*('\w+\s+)?(mut\s+)?self\b", p):
                        n, t = p.split(":", 1)
                        listed.append({"name": n.strip(), "type_annotation": t.strip(), "default_value": None})
                arrow = re.match(r"\s*->\s*(.*?)\s*(?:\bwhere\b|$)", source[close : body if body >= 0 else end - 1], re.S)
                marks = [w for w in (m["mods"] or "").split() if w in ("async", "unsafe", "const")]
                out.append(_symbol(m["name"], "method" if parent else "function", seen, first, last, text, parent, note, listed, arrow[1] if arrow else None, marks))
            elif m["value"]:
                out.append(_symbol(m["vname"], "const", seen, first, last, text, parent))
            else:
                out.append(_symbol(m["name"], m["kind"], seen, first, last, text, parent, note))
            at = end

    visit(0, len(code), None)
    return out


_TS = re.compile(r"\b(?:(?P<async>async)\s+)?function\s*\*?\s*(?P<fn>\w+)\s*(?:<[^>(]*>)?\s*(?=\()|\b(?:abstract\s+)?class\s+(?P<cls>\w+)|\binterface\s+(?P<itf>\w+)")
_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*)\*?(?P<name>#?[\w$]+)\s*(?:<[^>(]*>)?\s*(?=\()")


def ts_symbols(source: str) -> list[dict]:
    """Function declarations, classes with their methods, interfaces; arrow functions are not symbols."""
    code, out = _blanked(source), []

    def function(name: str, kind: str, start: int, after: int, limit: int, parent: str | None) -> int:
        par = code.find("(", after)
        close = _closing(code, par, "()")
        head = re.compile(r"\s*(?::\s*(?P<ret>[^{;=]+))?\s*(?=\{|;|\n|$)").match(code, close)
        body = code.find("{", head.end() if head else close)
        if body < 0 or code[head.end() if head else close : body].strip():
            return close
        end = min(_closing(code, body, "{}"), limit)
        listed = []
        for p in _split_list(source[par + 1 : close - 1]):
            n, _, value = p.partition("=") if not re.match(r"[^=]*:[^=]*=>", p) else (p, "", "")
            n, _, t = n.partition(":")
            listed.append({"name": n.strip().rstrip("?"), "type_annotation": t.strip() or None, "default_value": value.strip() or None})
        returns = source[head.start("ret") : head.end("ret")].strip() if head and head["ret"] else None
        first, last = source.count("\n", 0, start) + 1, source.count("\n", 0, end - 1) + 1
        out.append(_symbol(name, kind, "public", first, last, source[start:end], parent, None, listed, returns, []))
        return end

    at = 0
    while m := _TS.search(code, at):
        if m["fn"]:
            at = function(m["fn"], "function", m.start(), m.end(), len(code), None)
            continue
        body = code.find("{", m.end())
        end = _closing(code, body, "{}") if body >= 0 else len(code)
        first, last = source.count("\n", 0, m.start()) + 1, source.count("\n", 0, end - 1) + 1
        out.append(_symbol(m["cls"] or m["itf"], "class" if m["cls"] else "interface", "public", first, last, source[m.start() : end]))
        inner = body + 1
        while m["cls"] and body >= 0 and (x := _METHOD.search(code, inner - 1, end)):
            if x["name"] in ("if", "for", "while", "switch", "catch", "return", "function"):
                inner = x.end() + 1
                continue
            inner = max(x.end() + 1, function(x["name"], "method", x.start("mods") if x["mods"] else x.start("name"), x.end(), end, m["cls"]))
        at = max(end, m.end())
    return out


PARSERS = {"python": python_symbols, "rust": rust_symbols, "typescript": ts_symbols, "javascript": ts_symbols}


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS of each file (path, text) in a language with a parser, in source order; null texts give none."""
    schema = pa.schema(
        [("path", pa.string()), ("seq", pa.int32()), *((n, pa.string()) for n in ("name", "qualified_name", "kind", "visibility")), ("line_start", pa.int32()), ("line_end", pa.int32()), *((n, pa.string()) for n in ("text", "parent", "doc_comment")),
         ("parameters", pa.list_(pa.struct([(n, pa.string()) for n in ("name", "type_annotation", "default_value")]))), ("return_type", pa.string()), ("modifiers", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [{"path": path, "seq": k, **s} for k, s in enumerate(PARSERS[lang](text))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    known = files.select("path", "text", S.parsed_language(F.col("path")).alias("lang")).where(F.col("lang").isin(list(PARSERS)) & F.col("text").isNotNull())
    return known.mapInArrow(run, SYMBOLS)


def chunk_files(files: DataFrame, size: int = 240) -> DataFrame:
    """chunk_id, path, type, text, start, stop, symbol_name, visibility, metadata: symbols (start and stop are lines), else fixed windows.

    metadata is what is known of a symbol, its kind as its role; null for windows.
    """
    found = symbols(files)
    known = F.struct(
        F.col("name").alias("symbol_name"), "qualified_name", F.col("kind").alias("symbol_kind"), "visibility", "line_start", "line_end", F.col("parent").alias("parent_name"), "parameters", "return_type", "modifiers", "doc_comment",
        F.col("kind").alias("semantic_role"),
    )
    by_symbol = found.select(
        F.concat_ws("::", "path", "qualified_name").alias("chunk_id"), "path", S.kind_type(F.col("kind")).alias("type"), "text", F.col("line_start").alias("start"), F.col("line_end").alias("stop"),
        F.col("name").alias("symbol_name"), "visibility", known.alias("metadata"),
    )
    rest = fixed_windows(files.join(found.select("path").distinct(), "path", "left_anti"), size)
    windows = rest.select(S.text_chunk_id(F.col("path"), F.col("seq")).alias("chunk_id"), "path", F.lit("text").alias("type"), "text", "start", "stop", F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast(by_symbol.schema["metadata"].dataType).alias("metadata"))
    return by_symbol.unionByName(windows)
