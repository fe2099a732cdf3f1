"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Parts between single spaces: an empty text has one, runs of spaces count."""
    return F.size(F.split(text, " ", -1))


def word_count_any_space(text: Column) -> Column:
    """Parts between runs of white space."""
    return F.size(F.split(text, r"\s+", -1))


def token_estimate(text: Column) -> Column:
    """ceil(length / 8) for texts too long to encode; null where a tokenizer has to count."""
    n = F.length(text)
    return F.when(F.floor(n * 2 / 1024) >= 10, F.ceil(n / 8))


#: Symbols that stand for words in a slug, those that go, and those that a name of a workspace adds or takes out.
SYMBOLS = {"&": "and", "$": "dollar", "%": "percent", "<": "less", ">": "greater", "|": "or", "€": "euro", "£": "pound", "©": "(c)", "®": "(r)"}
SPELLED = {"+": " plus ", "!": " bang ", "@": " at ", "*": " splat ", ".": " dot ", ":": "", "~": "", "(": "", ")": "", "'": "", '"': "", "|": ""}


def slug_cased(text: Column, symbols: dict[str, str] | None = None) -> Column:
    """Words of ASCII letters and digits joined by a dash; symbols are spelled out, accents taken off."""
    out = text
    for c, word in {**SYMBOLS, **(symbols or {})}.items():
        out = F.replace(out, F.lit(c), F.lit(word))
    out = F.translate(out, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")
    kept = F.trim(F.regexp_replace(out, r"[^\w\s$*+~.()'\"!\-:@]+", ""))
    return F.regexp_replace(kept, r"\s+", "-")


def slug(text: Column) -> Column:
    """:func:`slug_cased` in lower case."""
    return F.lower(slug_cased(text))


def workspace_slug(name: Column) -> Column:
    """A name of letters, digits and dashes, symbols spelled out."""
    return F.lower(slug_cased(name, SPELLED))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "")


def command(text: Column) -> Column:
    """A slash command: everything but letters, digits, _ and - becomes a dash, lower case, with a slash in front."""
    return F.concat(F.lit("/"), F.lower(F.regexp_replace(text, "[^a-zA-Z0-9_-]", "-")))


def middle_truncate(text: Column, length: int = 5) -> Column:
    """Both ends of a text longer than ``length``, dots between."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length), F.lit("..."), F.right(text, F.lit(length))))


def fuzzy_match(text: Column, term: str, distance: int = 3) -> Column:
    """Contains the term, or is within an edit distance of it; a term under three characters matches nothing."""
    term = term.strip().lower()
    if len(term) < 3:
        return F.lit(False)
    low = F.lower(text)
    return F.contains(low, F.lit(term)) | F.levenshtein(low, F.lit(term), distance).between(0, distance)


def source_identifier(title: Column, published: Column) -> Column:
    """Null where either part is missing, so that it equals nothing."""
    return F.concat(F.lit("title:"), title, F.lit("-timestamp:"), published)


def chunk_source(value: Column) -> Column:
    """struct(type, source) of 'type://source', split at the first '://'; of confluence and github sources the query goes.  Both null without '://'."""
    has = F.instr(value, "://") > 0
    kind = F.substring_index(value, "://", 1)
    rest = F.regexp_extract(value, r"(?s)^.*?://(.*)$", 1)
    return F.struct(F.when(has, kind).alias("type"), F.when(has, F.when(kind.isin("confluence", "github"), F.regexp_replace(rest, r"(?s)\?.*$", "")).otherwise(rest)).alias("source"))


def valid_url(url: Column) -> Column:
    """http(s) with a host that is not in a private range; 127.0.0.1 and 0.0.0.0 are allowed."""
    host = F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1)
    private = host.rlike(r"^(192|172|10|127)\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$") & ~host.isin("127.0.0.1", "0.0.0.0")
    return F.coalesce((host != "") & ~private, F.lit(False))


def youtube_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|/v/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)


def agent_handles(prompt: Column) -> Column:
    """Words that start with @, of a prompt that starts with @agent."""
    return F.when(prompt.startswith("@agent"), F.filter(F.split(prompt, r"\s+"), lambda w: w.startswith("@"))).otherwise(F.array().cast("array<string>"))


def rounded_half_up(x: Column) -> Column:
    """Rounding with ties towards positive infinity."""
    return F.floor(x + 0.5)


def gigabytes(n: Column) -> Column:
    return F.floor(n / 1e9)


def camel_case(text: Column) -> Column:
    """Words, cut at other characters and before capitals, joined with capitals inside."""
    spaced = F.regexp_replace(F.regexp_replace(F.trim(text), r"([a-z0-9])([A-Z])", "$1 $2"), r"[_.\- ]+", " ")
    words = F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))), "")


def long_time(at: Column) -> Column:
    return F.date_format(at, "h:mm:ss a")


def long_date(at: Column) -> Column:
    return F.date_format(at, "MMMM d, yyyy")


def long_datetime(at: Column) -> Column:
    return F.date_format(at, "EEEE, MMMM d, yyyy h:mm a")


def shown_time(ms: Column, now: Column) -> Column:
    """Milliseconds, as text, as a local time; the present one for what is no number."""
    return F.date_format(F.coalesce(F.timestamp_millis(ms.try_cast("bigint")), now), "M/d/yyyy, h:mm:ss a")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def json_value(text: Column, path: str) -> Column:
    """The value at a path of dots, [n] and ['key']: see :func:`tessera.functions.json.value_at`."""
    from .json import value_at

    return value_at(text, path)
