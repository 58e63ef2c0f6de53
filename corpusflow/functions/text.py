"""Column functions on text, paths and identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules about names of files.
TEST_DIRS = ("test", "tests", "__tests__", "__mocks__", "spec", "specs", "e2e", "testdata")
TEST_NAMES = (r"^test_", r"_test\.[A-Za-z]+$", r"\.(test|spec)\.[A-Za-z]+$", r"_spec\.rb$", r"Tests?\.(java|kt|cs)$", r"^conftest\.py$")
DOC_EXTENSIONS = ("", ".md", ".markdown", ".rst", ".txt")
CHANGELOG_STEMS = ("changelog", "changes", "history", "news", "releases", "releasenotes", "whatsnew")
CHANGELOG_DIRS = ("changelog", "changes", "newsfragments", "changelog.d")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".php": "php", ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
}
CHARS_PER_TOKEN = 3


def estimate_tokens(c: Column) -> Column:
    """A third of the code points, rounded down."""
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("long")


def decode_text(content: Column) -> Column:
    """Bytes to text; invalid bytes become U+FFFD, CRLF becomes LF."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n", "\n")


def is_blank(c: Column) -> Column:
    """Nothing but white space."""
    return F.coalesce(F.rlike(c, F.lit(r"^\s*$")), F.lit(True))


def short_sha1(c: Column) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """The components of a relative path before its name."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def suffix(path: Column) -> Column:
    """A4: the last dot and what follows; none where the only dot leads or the name ends in one."""
    return F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1)


def stem_letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_test(path: Column) -> Column:
    """A10: a test by directory (any case) or by the pattern of its name."""
    lowered = F.transform(directories(path), F.lower)
    by_name = F.lit(False)
    for pattern in TEST_NAMES:
        by_name = by_name | F.rlike(file_name(path), F.lit(pattern))
    return F.arrays_overlap(lowered, F.array(*map(F.lit, TEST_DIRS))) | by_name


def is_changelog(path: Column) -> Column:
    """A10: a document whose stem, letters and digits only, names a changelog, or that stands in such a directory."""
    name, ext = file_name(path), F.lower(suffix(path))
    stem = F.when(ext == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ext)))
    lowered = F.transform(directories(path), F.lower)
    named = stem_letters(stem).isin(*CHANGELOG_STEMS)
    return ext.isin(*DOC_EXTENSIONS) & (named | F.arrays_overlap(lowered, F.array(*map(F.lit, CHANGELOG_DIRS))))


def language(path: Column) -> Column:
    """A10: by extension in any case; null where unknown."""
    table = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    return F.try_element_at(table, F.lower(suffix(path)))


def chunk_label(path: Column, parent: Column, symbol: Column, kind: Column, part: Column, part_count: Column, label: Column | None = None) -> Column:
    """`path · Parent.symbol (part i/n)`; the kind where there is no symbol. A label stands in place of the name."""
    qualified = qualified_name(parent, symbol) if label is None else F.coalesce(label, qualified_name(parent, symbol))
    note = F.when(part.isNotNull() & (part_count > 0), F.format_string(" (part %d/%d)", part + 1, part_count)).otherwise("")
    return F.concat(path, F.lit(" · "), F.when(qualified == "", kind).otherwise(qualified), note)


def qualified_name(parent: Column, symbol: Column) -> Column:
    both = (F.coalesce(parent, F.lit("")) != "") & (F.coalesce(symbol, F.lit("")) != "")
    return F.when(both, F.concat(parent, F.lit("."), symbol)).otherwise(F.coalesce(symbol, F.lit("")))


def fence_for(text: Column) -> Column:
    """Backticks, at least three and one more than the longest run in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
