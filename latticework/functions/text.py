"""Text functions as column expressions; a UDF only where Unicode tables or control flow ask for one."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Link patterns, slug alphabet, header of a reference list, share of a text that may be cut.
WIKILINK = r"!?\[\[([^\]|#]+)(?:\|[^\]]+)?\]\]"
MD_IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n"
SLUG_UNSAFE = r"[^A-Za-z0-9 \-_.,()']"
SLUG_CHARS = 70
REFERENCE_HEADER = r"\s*(?:[0-9]{1,3}[\.\)]?\s*)?(references|bibliography|참고\s*문헌)\s*[:\-]?\s*"
REFERENCE_SHARE = 0.4
SIMPLE = re.compile(r"[\x00-\x7f]*\Z")


def label_key(label: str) -> str:
    """NFKC, runs of anything but word characters to a blank, a blank between letter and digit, case folded."""
    s = label if SIMPLE.match(label) else unicodedata.normalize("NFKC", label)
    s = re.sub(r"\W+", " ", s)
    s = re.sub(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])", " ", s)
    return re.sub(r"\s+", " ", s).strip().casefold()


def _label_keys(labels: pa.Array) -> pa.Array:
    return pa.array([None if x is None else label_key(x) for x in labels.to_pylist()], pa.string())


def normalize_label(label: Column) -> Column:
    """Exact for any Unicode text. ASCII labels stay within code generation, only the others go through Arrow batches. Null stays null."""
    ascii_only = label.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(ascii_only, normalize_ascii(label)).otherwise(F.arrow_udf(_label_keys, StringType())(F.when(~ascii_only, label)))


def normalize_ascii(label: Column) -> Column:
    """The same for ASCII labels, within code generation."""
    s = F.regexp_replace(label, r"[^A-Za-z0-9_]+", " ")
    s = F.regexp_replace(s, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.lower(F.trim(F.regexp_replace(s, r" +", " ")))


def label_slug(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit("-"))


def slugify(title: Column) -> Column:
    """Folder name of a paper: safe characters only, blanks collapsed, 70 characters, never empty."""
    s = F.regexp_replace(F.coalesce(title, F.lit("")), SLUG_UNSAFE, " ")
    s = F.trim(F.regexp_replace(s, " +", " "))
    return F.coalesce(F.nullif(F.trim(F.substring(s, 1, SLUG_CHARS)), F.lit("")), F.lit("untitled"))


def wikilinks(body: Column) -> Column:
    """Distinct link targets, trimmed, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x)))


def md_images(body: Column) -> Column:
    """Paths of Markdown images, one for each occurrence."""
    return F.transform(F.regexp_extract_all(body, F.lit(MD_IMAGE), F.lit(1)), lambda x: F.trim(x))


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, FRONTMATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def table_cell(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def strip_references(text: Column) -> Column:
    """Cut from the first reference header in the second half of the lines that takes at most 40 % of the text along."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    at = F.sequence(F.floor(n / 2).cast("int") + 1, n)
    tail = lambda i: F.array_join(F.slice(lines, i, n), "\n")
    is_header = lambda i: F.element_at(lines, i).rlike(rf"(?iU)\A{REFERENCE_HEADER}\z")
    fits = lambda i: F.length(tail(i)) / F.greatest(F.length(text), F.lit(1)) <= REFERENCE_SHARE
    found = F.element_at(F.filter(at, lambda i: is_header(i) & fits(i)), 1)
    kept = F.array_join(F.slice(lines, F.lit(1), found - 1), "\n")
    return F.when(F.size(F.filter(at, lambda i: is_header(i) & fits(i))) > 0, F.regexp_replace(kept, r"(?U)\s+\z", "")).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or null, or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
