"""Prompt templates and names as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_commands(text: Column, presets: Iterable[tuple[str, str]], builtin: Iterable[str] = ("/reset",)) -> Column:
    """Commands replaced by their prompts, preset after preset, several in one text.

    A text that begins with a built-in command, in any case, is that command.
    A command counts at the start or after a word and a space, and up to a word
    boundary and a space or the end; the spaces go with it.
    """
    out = text
    for name, prompt in presets:
        out = F.regexp_replace(out, rf"(?:\b\s|^){re.escape(name)}(?:\b\s|$)", re.sub(r"([\\$])", r"\\\1", prompt))
    whole = None
    for name in builtin:
        begins = F.startswith(F.lower(text), F.lit(name.lower()))
        whole = F.when(begins, F.lit(name)) if whole is None else whole.when(begins, F.lit(name))
    return out if whole is None else whole.otherwise(out)


def fill_variables(text: Column, values: Mapping[str, Column]) -> Column:
    """``{key}`` replaced by its value.

    An unknown or empty one stays as it is, but ``{user.x}`` without a value
    becomes ``[User x]``.  Values are not expanded again.
    """
    # Every text is a sequence of these parts, so the parts joined are the text.
    parts = F.regexp_extract_all(text, F.lit(r"([^{]+|\{[^}]+\}|\{)"), 1)

    def filled(part: Column) -> Column:
        out = None
        for name, value in values.items():
            given = F.when(value != "", value)
            hit = part == F.lit("{" + name + "}")
            known = F.coalesce(given, unset(part))
            out = F.when(hit, known) if out is None else out.when(hit, known)
        return unset(part) if out is None else out.otherwise(unset(part))

    def unset(part: Column) -> Column:
        user = F.regexp_extract(part, r"^\{user\.([^.}]*)[^}]*\}$", 1)
        return F.when(part.rlike(r"^\{user\.[^}]*\}$"), F.concat(F.lit("[User "), user, F.lit("]"))).otherwise(part)

    return F.array_join(F.transform(parts, filled), "")


def dashed_namespace(name: Column, prefix: str = "tessera-") -> Column:
    """3 to 63 letters, digits, _ and -, both ends a letter or digit.

    A wrong first character gives way to the prefix, a wrong last one goes, a
    short name gets the prefix, a long one is cut.
    """
    plain = F.regexp_replace(name, "[^a-zA-Z0-9_-]", "-")
    led = F.regexp_replace(plain, "^[_-]", prefix)
    trimmed = F.regexp_replace(led, "[_-]$", "")
    n = F.length(trimmed)
    fitted = F.when(n < 3, F.concat(F.lit(prefix), trimmed)).when(n > 63, F.regexp_replace(F.substring(trimmed, 1, 63), "[_-]$", "")).otherwise(trimmed)
    return F.when(name.rlike("^[a-zA-Z0-9][a-zA-Z0-9_-]{1,61}[a-zA-Z0-9]$"), name).otherwise(fitted)


def underscored_namespace(name: Column, prefix: str = "tessera_") -> Column:
    """Letters, digits and _; a name that starts with a letter or _ gets the prefix."""
    plain = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    return F.when(plain.rlike("^[a-zA-Z_]"), F.concat(F.lit(prefix), plain)).otherwise(plain)


def marked_namespace(name: Column) -> Column:
    """ns_ and letters, digits and _; a name that has the mark stays as it is."""
    return F.when(name.startswith("ns_"), name).otherwise(F.concat(F.lit("ns_"), F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")))
