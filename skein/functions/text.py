"""Scalar functions of the engine as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEST_PATH = r"(?i)(^|[\\/])tests?[\\/]|\.test\.|\.spec\."
#: Words of a question that alone never lift a label.
STOP_WORDS = (
    "get", "set", "put", "add", "new", "list", "show", "find", "use",
    "with", "from", "into", "what", "how", "the", "for", "and", "are",
    "all", "any", "this", "that", "route", "routes", "file", "files",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_id(file: Column | str, name: Column | str) -> Column:
    """Path with separators as underscores and its last extension cut, underscore, cleaned name."""
    stem = F.regexp_replace(F.regexp_replace(col(file), r"[\\/]", "_"), r"\.[^.]+\z", "")
    return F.concat(stem, F.lit("_"), F.regexp_replace(col(name), r"[^a-zA-Z0-9_$]", "_"))


def is_test_path(path: Column | str) -> Column:
    return F.coalesce(col(path).rlike(_TEST_PATH), F.lit(False))


def words_of(text: Column | str) -> Column:
    """Lower-cased alphanumeric runs of two characters or more, camelCase split."""
    c = F.regexp_replace(F.regexp_replace(col(text), "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(c, "[^a-zA-Z0-9]+"), F.lower), lambda t: F.length(t) > 1)


def token_estimate(text: Column | str) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(col(text), "UTF-16BE")) / 8).cast("long")


def round_half_up(x: Column | str, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, in doubles."""
    p = float(10**digits)
    return F.floor(col(x) * p + 0.5) / p


def content_hash(content: Column | str) -> Column:
    return F.substring(F.sha2(col(content), 256), 1, 16)


def extension(path: Column | str) -> Column:
    return F.regexp_extract(F.element_at(F.split(col(path), r"[\\/]"), -1), r".(\.[^.]*)\z", 1)


def last_segment(name: Column | str) -> Column:
    return F.element_at(F.split(col(name), r"\\"), -1)


def before_last_dot(label: Column | str) -> Column:
    return F.regexp_extract(col(label), r"(?s)^(.*)\.", 1)


def resolve_short_name(short: Column | str, imports: Column, namespace: Column) -> Column:
    """An import's full name, else namespace\\short, else short."""
    return F.coalesce(F.try_element_at(imports, col(short)), F.when(F.coalesce(namespace, F.lit("")) != "", F.concat(namespace, F.lit("\\"), col(short))), col(short))
