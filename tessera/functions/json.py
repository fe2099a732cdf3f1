"""JSON texts: tolerant parsing, paths, merging, flattening and tool-call checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\[(?:'([^']*)'|\"([^\"]*)\"|([^\]]*))\]|([^.\[]+)")


def path_steps(path: str) -> list[str | int]:
    """Keys and indices of a path of dots, [n] and ['key']."""
    out: list[str | int] = []
    for m in _STEP.finditer(path):
        key = next(g for g in m.groups() if g is not None)
        out.append(int(key) if m[4] is None and re.fullmatch(r"\d+", key) else key)
    return out


def value_at(text: Column, path: str) -> Column:
    """The value at a path as text, objects and arrays as JSON.

    The empty string for an empty path and for what is no object or array or has
    nothing in it; null where the path leads nowhere.
    """
    steps = path_steps(path)
    if not steps:
        return F.lit("")
    where = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    good = F.try_parse_json(text).isNotNull() & F.trim(text).rlike(r"^[{\[]") & ~F.trim(text).rlike(r"^(\{\s*\}|\[\s*\])$")
    return F.when(F.coalesce(good, F.lit(False)), F.get_json_object(text, where)).otherwise(F.lit(""))


def substitute(template: str, variables: Column) -> Column:
    """``template`` with each ``${path}`` replaced by the value in a JSON object; a path without a value stays as it is."""
    parts = re.split(r"(\$\{[^}]+\})", template)
    filled = [F.coalesce(value_at(variables, p[2:-1]), F.lit(p)) if p.startswith("${") and p.endswith("}") else F.lit(p) for p in parts if p]
    return F.concat(*filled) if filled else F.lit("")


def _scan(s: str, i: int, fix: bool) -> tuple[object, int]:
    """The value at ``i`` and the place behind it; with ``fix``, single quotes, bare words, missing and extra commas and open ends pass."""
    while i < len(s) and s[i].isspace():
        i += 1
    if i >= len(s):
        raise ValueError("no value")
    if s[i] in "{[":
        close, isobject = ("}", True) if s[i] == "{" else ("]", False)
        out: dict | list = {} if isobject else []
        i += 1
        while True:
            while i < len(s) and (s[i].isspace() or s[i] == ","):
                i += 1
            if i >= len(s):
                if fix:
                    return out, i
                raise ValueError("open end")
            if s[i] == close:
                return out, i + 1
            value, i = _scan(s, i, fix)
            if isobject:
                while i < len(s) and s[i].isspace():
                    i += 1
                if i >= len(s) or s[i] != ":":
                    raise ValueError("no colon")
                out[str(value)], i = _scan(s, i + 1, fix)
            else:
                out.append(value)
    if s[i] in "\"'":
        end = re.compile(r"(?:[^\\%s]|\\.)*" % s[i], re.S).match(s, i + 1).end()
        body = s[i + 1 : end]
        if s[i] == "'":
            body = body.replace('"', '\\"')
        return json.loads(f'"{body}"', strict=False), min(end + 1, len(s))
    m = re.compile(r"[^\s,:\]}\[{]+").match(s, i)
    if not m:
        raise ValueError("no value")
    word = m[0]
    try:
        return json.loads(word), m.end()
    except ValueError:
        return {"True": True, "False": False, "None": None, "undefined": None}.get(word, word), m.end()


def parse_tolerant(text: str | None) -> object:
    """Strictly; else mended where it starts like JSON; else the first object or array in the text; else None."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        pass
    if text.startswith(("[", "{")):
        try:
            return _scan(text, 0, True)[0]
        except (ValueError, RecursionError):
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def tolerant(text: Column, fallback: str | None = None) -> Column:
    """JSON in canonical form of what :func:`parse_tolerant` reads; texts that are JSON already never leave the JVM's parser."""

    @F.arrow_udf("string")
    def mend(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            value = parse_tolerant(t)
            out.append(fallback if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        return pa.array(out, pa.string())

    strict = F.try_parse_json(text)
    return F.when(strict.isNotNull(), F.to_json(strict)).otherwise(mend(F.when(strict.isNull(), text)))


def stringify(df: DataFrame, *columns: str) -> Column:
    """A JSON object of columns of ``df``, nulls left out; integers that a double can't hold are strings."""
    parts = []
    for c in columns:
        part = F.to_json(F.struct(F.col(c).alias(c)))
        if isinstance(df.schema[c].dataType, (T.LongType, T.DecimalType)):
            part = F.when(F.abs(F.col(c)) > 2**53 - 1, F.to_json(F.struct(F.col(c).cast("string").alias(c)))).otherwise(part)
        parts.append(F.regexp_replace(part, r"^\{|\}$", ""))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ","), F.lit("}"))


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the new one's values win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def without_key(value: Column, key: str) -> Column:
    return F.map_filter(value, lambda k, _: k != key)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns ``a_b``; arrays only of plain values; columns named id go, at any depth."""

    def walk(kind: T.StructType, at: str, name: str) -> Iterator[Column]:
        for f in kind:
            if f.name == "id":
                continue
            where, called = f"{at}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, f"{where}.", f"{called}{sep}")
            elif isinstance(f.dataType, T.ArrayType):
                if not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
                    yield F.when(F.size(where) > 0, F.col(where)).alias(called)
            else:
                yield F.col(where).alias(called)

    return df.select(*walk(df.schema, "", ""))


def call_problem(call: Column, functions: Mapping[str, tuple[list[str], list[str]]]) -> Column:
    """What is wrong with a tool call in JSON, null if nothing: ``functions`` maps a name to (parameters, required ones)."""
    name, args = F.get_json_object(call, "$.name"), F.get_json_object(call, "$.arguments")
    keys = F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))
    missing_part = F.lit("Missing name or arguments in function call.")
    out = F.when(name.isNull() | args.isNull(), missing_part)
    out = out.when(~name.isin(*functions), F.lit("Function name does not exist.")) if functions else out.otherwise(F.lit("Function name does not exist."))
    for f, (parameters, required) in functions.items():
        for r in required:
            out = out.when((name == f) & ~F.array_contains(keys, r), F.lit(f"Missing required argument: {r}"))
        extra = F.array_except(keys, F.array(*map(F.lit, parameters))) if parameters else keys
        out = out.when((name == f) & (F.size(extra) > 0), F.concat(F.lit("Unknown argument: "), F.element_at(extra, 1), F.lit(" provided but not in schema.")))
    return out


def content_text(content: Column) -> Column:
    """The texts of an array of (type, text, url) parts, one to a line."""
    return F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def attachments(content: Column) -> Column:
    """(name, mime, content) of the image parts; the type is that of a data URL, else PNG."""
    mime = lambda u: F.when(u.rlike("^data:[^;]+;base64,"), F.lower(F.regexp_extract(u, "^data:([^;]+);base64,", 1))).otherwise("image/png")
    images = F.filter(content, lambda p: p["type"] == "image_url")
    return F.transform(images, lambda p, i: F.struct(F.concat(F.lit("uploaded_image_"), i.cast("string")).alias("name"), mime(p["url"]).alias("mime"), p["url"].alias("content")))


def with_value(text: Column, key: str, value: Column) -> Column:
    """A JSON object of text values with one key set."""
    return F.to_json(merged(F.from_json(text, "map<string,string>"), F.create_map(F.lit(key), value)))
