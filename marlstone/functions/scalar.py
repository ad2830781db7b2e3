"""Column functions: paths, types and roles, scores, tokens and costs. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

MARKER = "\n... [truncated] ...\n"


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """What the table holds for `key`."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


# Paths


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; none for a dotfile or a name that ends in a dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def in_directory(path: Column, names: list[str]) -> Column:
    """Whether a directory of the relative path has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(n) for n in names]))


def archive_url(url: Column, branch: str = "main") -> Column:
    """The address of a repository's archive of a branch on the same site's usual path."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "/")
    return F.format_string(f"https://github.com/%s/%s/archive/refs/heads/{branch}.zip", F.element_at(parts, -2), F.element_at(parts, -1))


def output_name(source: Column) -> Column:
    """Name of a pack: the source's last part without .git or .zip."""
    return F.concat(F.regexp_replace(F.regexp_replace(basename(F.regexp_replace(source, "/+$", "")), r"\.git$", ""), r"\.zip$", ""), F.lit(".docpack"))


def language(path: Column) -> Column:
    return lookup(fixed.LANGUAGES, F.lower(suffix(path)))


def text_format(path: Column) -> Column:
    return lookup(fixed.FORMATS, F.lower(suffix(path)))


def parsed_language(path: Column) -> Column:
    return lookup(fixed.PARSED, F.lower(suffix(path)))


def is_code_file(path: Column) -> Column:
    return F.lower(suffix(path)).isin(fixed.CODE_EXTENSIONS)


def is_binary_file(path: Column) -> Column:
    return F.lower(suffix(path)).isin(fixed.BINARY_EXTENSIONS)


def is_text_file(path: Column) -> Column:
    name = basename(path)
    return F.lower(suffix(path)).isin(fixed.TEXT_FILES) | name.isin(fixed.TEXT_FILES) | (name.startswith(".") & (suffix(path) == ""))


def is_marker(path: Column) -> Column:
    name = basename(path)
    ends = [name.endswith(m[1:]) for m in fixed.PROJECT_MARKERS if m[0] == "*"]
    return reduce(Column.__or__, ends, name.isin([m for m in fixed.PROJECT_MARKERS if m[0] != "*"]))


# Identity


def chunk_id(domain: Column, path: Column, start: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", domain, path, start.cast("string")), 256), 1, 12))


def text_chunk_id(path: Column, counter: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(path, 256), 1, 8), F.lit("_"), F.lpad(counter.cast("string"), 6, "0"))


def qualified_name(parent: Column, name: Column) -> Column:
    return F.concat_ws("::", parent, name)


# Types and roles


def _contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks])


def infer_type(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    comment = reduce(Column.__or__, [F.startswith(low, F.lit(m)) for m in fixed.COMMENT_STARTS])
    out = F.when(comment, "comment").otherwise("text")
    for name, marks in reversed(fixed.TYPE_MARKS):
        out = F.when(_contains_any(low, marks), name).otherwise(out)
    return out


def infer_role(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, marks in reversed(fixed.ROLE_MARKS):
        out = F.when(_contains_any(low, marks), name).otherwise(out)
    return out


def kind_type(kind: Column) -> Column:
    return lookup(fixed.KIND_TYPES, F.lower(kind), "text")


def element_type(kind: Column) -> Column:
    return lookup(fixed.ELEMENT_TYPES, kind, "text")


# Scores


def cyclomatic(text: Column) -> Column:
    """1 and all matches of the branch patterns; `else if` counts for itself and for its `if`.

    Matches of one pattern never share a character with those of another, but for the two that are counted on their own, so all
    others are one pattern and one pass over the text.
    """
    alone = [p for p in fixed.BRANCHES if p in fixed.SHARING_BRANCHES]
    rest = "|".join(p for p in fixed.BRANCHES if p not in alone)
    return reduce(Column.__add__, [F.regexp_count(text, F.lit("(?i)" + p)) for p in (rest, *alone)], F.lit(1))


def complexity_score(text: Column, line_start: Column, line_end: Column, cyclo: Column | None = None) -> Column:
    n, cc = F.length(text), cyclomatic(text) if cyclo is None else cyclo
    size = F.when(n >= 100, 0.4 * F.least(F.lit(1.0), n / 1000.0)).otherwise(0.0)
    branches = F.when(cc >= 4, 0.4 * F.least(F.lit(1.0), cc / 10.0)).otherwise(0.0)
    lines = F.when((line_start != 0) & (line_end != 0), 0.2 * F.least(F.lit(1.0), (line_end - line_start) / 200.0)).otherwise(0.0)
    return F.least(F.lit(1.0), F.coalesce(size, F.lit(0.0)) + F.coalesce(branches, F.lit(0.0)) + lines)


def structural_score(kind: Column, depth: Column, visibility: Column) -> Column:
    base = F.when(kind.isin(*fixed.HIGH_TYPES), 1.0).when(kind.isin(*fixed.SECOND_TYPES), 0.3).otherwise(0.0)
    deep = base * F.when(depth > 1, F.pow(F.lit(0.8), depth - 1)).otherwise(1.0)
    return F.when(visibility == "public", F.least(F.lit(1.0), deep * 1.2)).when(visibility == "private", deep * 0.7).otherwise(deep)


def weighted_score(structural: Column, semantic: Column, complexity: Column, weights: tuple[float, float, float] = (0.5, 0.35, 0.15)) -> Column:
    if not 0.99 <= sum(weights) <= 1.01:
        raise ValueError("weights add up to 1")
    return weights[0] * structural + weights[1] * semantic + weights[2] * complexity


def boosted(semantic: Column, rank: Column) -> Column:
    return F.least(F.lit(1.0), semantic * (1 + 0.3 * rank))


# Tokens and costs


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def size_class(n: Column) -> Column:
    return F.when(n > 1000, "large").when(n >= 300, "medium").otherwise("small")


def truncated(text: Column, max_tokens: int = 800) -> Column:
    """Beyond the budget, the first 70% and last 30% of what the marker leaves, trimmed where they meet it."""
    room = max(0, 4 * max_tokens - len(MARKER))
    head, tail = room * 7 // 10, room * 3 // 10
    first = F.regexp_replace(F.substring(text, 1, head), r"\s+$", "")
    last = F.regexp_replace(F.right(text, F.lit(tail)), r"^\s+", "") if tail else F.lit("")
    return F.when(tokens(text) <= max_tokens, text).otherwise(F.concat(first, F.lit(MARKER), last))


def retry_truncated(text: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), F.floor(F.length(text) * 0.75).cast("int")), F.lit(MARKER))


def preview(text: Column) -> Column:
    one = F.regexp_replace(F.replace(F.substring(text, 1, 200), F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    return F.concat(one, F.when(F.length(text) > 200, "...").otherwise(""))


def cost(n: Column, price: Column, discount: float = 0.0) -> Column:
    """USD of n tokens at a price for 10^6; nothing where there is no price."""
    return F.coalesce(n / 1e6 * price, F.lit(0.0)) * (1 - discount)


def output_cap(n: Column) -> Column:
    return F.least(1024 * n, F.lit(16384))


def request_tokens(text: Column, n: Column) -> Column:
    return tokens(text) + 200 * n


def found_json(text: Column) -> Column:
    """JSON in an answer: the whole, the first fenced block that parses, or from the first to the last brace; null where none parses."""
    parsed = lambda x: F.try_parse_json(F.nullif(F.trim(x), F.lit("")))
    fenced = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"), F.lit(1)), lambda x: F.to_json(parsed(x)))
    first = F.get(F.filter(fenced, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.to_json(parsed(text)), first, F.to_json(parsed(F.regexp_extract(text, r"(?s)\{.*\}", 0))))


def lacking_keys(json: Column, keys: list[str]) -> Column:
    """Those of the keys that a JSON object does not have, in their order; all of them where it is none."""
    have = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in keys]), have)
