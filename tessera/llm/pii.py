"""Personal data: fixed patterns, and candidates selected by boosted trees.

The fixed patterns (email, ip, card, phone) are always reported.  High-recall
generators propose further spans that may overlap: telephone numbers without a
plus sign, addresses written out ("name at host dot org"), version 6 internet
addresses, bank accounts, national identity numbers and mistyped cards.  Boosted
trees rate each candidate by its format and its context, thresholds calibrated
per kind select, and of overlapping selections the one rated highest stays.

No table has labels for personal data, so the trees are fitted to examples made
from the templates below, with a fixed seed: proposals with personal data in
them, and look-alikes (versions, prices, dates, order numbers, ratios, hashes).
Every text is handled by itself, in a slice of rows, without a shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit_forest

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "national_id"]
_RANK = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits whose start fails has no later start that matches, so only its start is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[Span]:
    """Matches of the fixed patterns as (start, end, kind), each kind leftmost and not overlapping itself."""
    out: list[Span] = []
    if "@" in t:
        done = 0
        for m in _DOMAIN.finditer(t):
            a = m.start()
            while a > done and t[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, m.end(), "email"))
                done = m.end()
    if _DIGIT.search(t):
        if "." in t:
            out += [(*m.span(), "ip") for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(t):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in t:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]]))


# Generators.  Each has a test that a text must pass before the pattern is tried.
_GENERATORS = [
    ("email", "written_out", ("dot", "DOT", "Dot"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s{0,2}[\[({]?\s?\b(?:at|AT|At)\b\s?[\])}]?\s{0,2}[A-Za-z0-9-]{1,63}(?:\s{0,2}[\[({]?\s?\b(?:dot|DOT|Dot)\b\s?[\])}]?\s{0,2}[A-Za-z0-9-]{2,63}){1,3}")),
    ("email", "spaced", ("@",), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\s?[\[({]\s?@\s?[\])}]\s?|\s@\s)[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{2,63}){1,3}")),
    ("ip", "version6", (":",), re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])")),
    ("card", "grouped", None, re.compile(r"(?<![0-9.,/-])[3-6][0-9]{3}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{3,4}(?![0-9])")),
    ("phone", "national", None, re.compile(r"(?<![0-9A-Za-z.,/+-])(?:\(0?[0-9]{2,4}\)\s?|0?[0-9]{2,4}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")),
    ("phone", "plus", ("+",), re.compile(r"\+\s?[0-9]{1,3}[\x20().0-9/-]{5,18}[0-9](?![0-9A-Za-z])")),
    ("iban", "iban", None, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("national_id", "social", ("-",), re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
]

_CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|reach|correo|courriel|adresse)\b"),
    "ip": re.compile(r"(?i)\b(ip|server|host|address|login|from|client)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|debit|mastercard|amex|carte|karte|tarjeta|pay)"),
    "phone": re.compile(r"(?i)\b(call|tel|phone|mobile|cell|fax|dial|sms|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono|ruf)"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta|transfer)"),
    "national_id": re.compile(r"(?i)\b(ssn|social|security|identity|id|insurance|national)\b"),
}
_AGAINST = re.compile(r"(?i)\b(version|order|invoice|isbn|page|pages|score|ratio|price|total|section|chapter|art|no|nr|ref|serial|build|commit|hash|between|date)\b")
_CONTEXT = 40


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    form: str


def candidates(t: str) -> list[Candidate]:
    """Everything that the generators propose, overlaps included."""
    digits = _DIGIT.search(t) is not None
    return [
        Candidate(*m.span(), kind, form)
        for kind, form, needs, pattern in _GENERATORS
        if (digits if needs is None else any(n in t for n in needs))
        for m in pattern.finditer(t)
    ]


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidate_features(t: str, c: Candidate) -> list[float]:
    """Format: kind, length, digits, separators, check digits.  Context: cues on either side, neighbours."""
    s = t[c.start : c.end]
    before, after = t[max(0, c.start - _CONTEXT) : c.start], t[c.end : c.end + _CONTEXT]
    d = _digits(s)
    groups = re.split(r"[^0-9]+", s.strip("()+ "))
    return [
        float([g[1] for g in _GENERATORS].index(c.form)), float(len(s)), float(len(d)), float(len(groups)),
        float(len({len(g) for g in groups})), float(sum(x in " ()./-" for x in s)), float(len(set(s) & set(" ()./-"))),
        float(bool(d) and luhn(d)), float(_iban(s)) if c.kind == "iban" else 0.0, float("(" in s or "[" in s),
        float(bool(_CUES[c.kind].search(before))), float(bool(_CUES[c.kind].search(after))), float(bool(_AGAINST.search(before))),
        float(before[-1:].isalnum() or after[:1].isalnum()), float(before[-1:] in "$€£#%=" and before[-1:] != ""), float(sum(x.isdigit() for x in before + after)),
        float(d[:1] == "0"), float(len(set(d)) if d else 0),
    ]


# Templates of examples: (what a proposal looks like, does it hold personal data).  A "#" is a random digit, "@w" a word.
_MADE = [
    ("@w.@w at @w dot com", 1), ("@w [at] @w [dot] org", 1), ("@w (at) @w (dot) net", 1), ("@w.@w AT @w DOT @w DOT fr", 1), ("@w at @w dot @w", 0), ("@w @ @w.com", 1), ("@w(@)@w.org", 1), ("@w [@] @w.de", 1),
    ("2001:db8:#:#:#:#:#:#", 1), ("fe80::#:#:#:#", 1), ("#:#", 0), ("1#:4#::#", 0), ("4### #### #### ####", 1), ("5###-####-####-####", 1), ("3###.####.####.####", 0), ("6### #### #### ####", 0),
    ("(###) ###-####", 1), ("###-###-####", 1), ("###.###.####", 1), ("0## ## ## ## ##", 1), ("0###/######", 1), ("0### ### ####", 1), ("(0##) #### ####", 1), ("+## ## ### ## ##", 1), ("+#/###/###-####", 1),
    ("20## 20## 20##", 0), ("## ### ### ###", 0), ("1#/1#/20##", 0), ("20##-1#-2#", 0), ("## ### ###", 0), ("##.##.20##", 0), ("###-##-##", 0), ("### ### ###", 0), ("##-##-##", 0),
    ("###-##-####", 1), ("DE## #### #### #### #### ##", 1), ("FR##############", 1), ("AB12CD34EF56GH78", 0), ("ISO9####AB12CD34", 0), ("#.##.###.#", 0),
]
_POSITIVE_CUES = {"email": ["email", "contact", "write"], "ip": ["server", "ip", "host"], "card": ["card", "visa", "credit card"], "phone": ["call", "tel", "phone"], "iban": ["iban", "account"], "national_id": ["ssn", "social security"]}
_NEGATIVE_CUES = ["version", "order", "invoice", "isbn", "page", "score", "price", "ref", "build"]


def made_examples(seed: int = 11, each: int = 60, part: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind) of the proposals in sentences made from the templates, or from every second one of them, from ``part`` on."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(["an", "er", "th", "on", "le", "re", "in", "st", "de", "ou", "a", "e"]) for _ in range(r.randint(1, 3)))

    x, y, kinds = [], [], []
    for template, label in _MADE if part is None else _MADE[part::2]:
        for _ in range(each):
            s = re.sub("@w", lambda _: word(), re.sub("#", lambda _: r.choice("0123456789"), template))
            text = " ".join(word() for _ in range(8)) + " "
            found = candidates(s)
            cue = r.random()
            if found and label and cue < 0.5:
                text += r.choice(_POSITIVE_CUES[found[0].kind]) + r.choice([" ", ": "])
            elif not label and cue < 0.5:
                text += r.choice(_NEGATIVE_CUES) + " "
            at = len(text)
            text += s + r.choice([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(8))
            for c in candidates(text):
                if c.start < at + len(s) and c.end > at:
                    whole = c.start >= at and c.end <= at + len(s) and 10 * (c.end - c.start) >= 8 * len(s)
                    x.append(candidate_features(text, c))
                    y.append(float(label and whole))
                    kinds.append(_RANK[c.kind])
    return np.array(x), np.array(y), np.array(kinds)


@dataclass(frozen=True)
class Selector:
    forest: Forest
    thresholds: list[float]  # by kind, on the margin


def fit_selector(precision: float = 0.95) -> Selector:
    """Fit the trees to half of the templates, then calibrate each kind's threshold on all, made anew.

    The threshold is the lowest margin from which on the share of personal data
    among higher-rated examples of the kind is at least ``precision``; a kind
    without such a margin selects nothing.
    """
    x, y, _ = made_examples(part=0)
    forest = fit_forest(x, y)
    x, y, kinds = made_examples(seed=12)
    margin, out = forest.margin(x), []
    for k in range(len(KINDS)):
        m, t = margin[kinds == k], y[kinds == k]
        order = np.argsort(-m, kind="stable")
        share = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(share >= precision)
        out.append(max(0.0, float(m[order[good[-1]]])) if len(good) else float("inf"))
    return Selector(forest, out)


def selector_quality(selector: Selector, seed: int = 13, part: int | None = 1) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, examples) by kind on sentences of templates that the trees were not fitted to."""
    x, y, kinds = made_examples(seed, part=part)
    chosen = selector.forest.margin(x) >= np.array(selector.thresholds)[kinds]
    out = {}
    for k, name in enumerate(KINDS):
        of = kinds == k
        if of.any():
            hit = float((chosen & (y > 0))[of].sum())
            out[name] = (hit / max(1.0, float(chosen[of].sum())), hit / max(1.0, float(y[of].sum())), int(of.sum()))
    return out


def added_spans(t: str, base: list[Span], selector: Selector) -> list[Span]:
    """Selected candidates that touch neither a base span nor a better-rated selection."""
    found = candidates(t)
    if not found:
        return []
    margin = selector.forest.margin(np.array([candidate_features(t, c) for c in found]))
    chosen = [(-m, c.start, c.end, c.kind) for m, c in zip(margin, found) if m >= selector.thresholds[_RANK[c.kind]]]
    # Spans taken do not overlap one another, so a place in their order decides.
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b, _ in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out: list[Span] = []
    for _, a, b, kind in sorted(chosen):
        at = bisect_left(taken, (a, b))
        if (at == len(taken) or b <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= a):
            taken.insert(at, (a, b))
            out.append((a, b, kind))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1])))


def personal_data(text: Column, selector: Selector) -> Column:
    """A struct of the counts of the four base kinds, ``base`` and ``spans`` (kind:start:end, comma-joined)."""
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base: string, spans: string>")
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            t = x.as_py() or ""
            base = base_spans(t)
            spans = base + added_spans(t, base, selector)
            names = [s[2] for s in base]
            rows.append((*(names.count(k) for k in BASE_KINDS), joined(base), joined(spans)))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], fields=list(kind))

    return find(text)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans as :func:`personal_data` gives them."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(texts.to_pylist(), given.to_pylist()):
            if x is not None and y:
                at, parts = 0, []
                for k, a, b in (s.split(":") for s in y.split(",")):
                    if int(b) > at:
                        parts += [x[at : max(at, int(a))], f"[{k}]"] if int(a) >= at else []
                        at = int(b)
                x = "".join(parts) + x[at:]
            out.append(x)
        return pa.array(out, pa.string())

    return cut(text, spans)


def find_personal_data(docs: DataFrame, selector: Selector | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the fields of :func:`personal_data`, replacing columns of these names.

    Defined results: a null or empty text has no spans; repeated rows give
    repeated results; an empty table stays empty.
    """
    out = docs.withColumn("_found", personal_data(F.col(f"`{text}`"), fit_selector() if selector is None else selector))
    for name in [*(f"n_{k}" for k in BASE_KINDS), "base", "spans"]:
        out = out.withColumn(name, F.col(f"_found.{name}"))
    return out.drop("_found")


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
