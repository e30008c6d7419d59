"""Column functions on repository paths and node ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language and role by extension.
LANGUAGES = {
    "python": ("py",),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "rust": ("rs",),
    "go": ("go",),
    "java": ("java",),
    "csharp": ("cs",),
    "markdown": ("md", "markdown"),
    "json": ("json",),
    "toml": ("toml",),
    "yaml": ("yaml", "yml"),
}
DOCS = ("md", "markdown", "rst", "txt")
CONFIG = ("toml", "json", "yaml", "yml", "ini", "cfg", "lock")
#: Other spellings of a language.
SPELLINGS = {"c#": "csharp", "c-sharp": "csharp", "cs": "csharp", "ts": "typescript", "js": "javascript", "py": "python", "golang": "go"}
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "testing")
#: Names of test files by the viewer's rule.
TEST_FILES = (r"(?i)(^|[/\\])test_[^/\\]*\.[^/\\]+$", r"(?i)_tests?\.[^/\\]+$", r"(?i)\.(test|spec)\.[^/\\]+$", r"(?i)[^/\\]+Tests?\.(java|cs|kt|scala)$")
EXACT, NAME_MATCH = 0.95, 0.5
#: Kinds of nodes that are symbols.
SYMBOLS = ("Function", "Class", "Interface", "Enum", "Variable")


def basename_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    """'' at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def parent_of(path: Column) -> Column:
    """'.' at the root."""
    return F.when(dir_of(path) == "", ".").otherwise(dir_of(path))


def extension_of(path: Column) -> Column:
    """Lower-case, '' if there is none or the name only starts with a dot."""
    return F.lower(F.regexp_extract(basename_of(path), r"^.+\.([^.]*)$", 1))


def language_for(extension: Column) -> Column:
    out = F.when(extension.isNull(), "unknown")
    for name, extensions in LANGUAGES.items():
        out = out.when(extension.isin(*extensions), name)
    return out.otherwise("unknown")


def is_test_path(path: Column) -> Column:
    """The engine's and server's rule."""
    low, base, original = F.lower(path), F.lower(basename_of(path)), basename_of(path)
    in_dir = F.exists(F.split(low, "/"), lambda s: s.isin("test", "tests") | s.endswith(".tests"))
    named = reduce(Column.__or__, (base.contains(x) for x in ("_test.", ".test.", ".spec.", ".tests.")))
    suffix = reduce(Column.__or__, (original.endswith(x) for x in ("Test.java", "Tests.java", "Tests.cs")))
    return in_dir | base.startswith("test_") | named | suffix


def role_for(path: Column, extension: Column) -> Column:
    return F.when(is_test_path(path), "testing").when(extension.isin(*DOCS), "docs").when(extension.isin(*CONFIG), "config").otherwise("doing")


def is_test_path_viewer(path: Column) -> Column:
    """The viewer's rule, which is broader."""
    segments = F.exists(F.split(F.lower(path), r"[/\\]"), lambda s: s.isin(*TEST_SEGMENTS))
    return (path != "") & (reduce(Column.__or__, (path.rlike(x) for x in TEST_FILES)) | segments)


def normalize_language(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    out = F.when(low.isNull(), "")
    for spelling, name in SPELLINGS.items():
        out = out.when(low == spelling, name)
    return out.otherwise(low)


def bucket_confidence(resolution: Column, confidence: Column) -> Column:
    """The edge's resolution, or what its confidence amounts to."""
    return F.coalesce(resolution, F.when(confidence >= EXACT, "exact").when(confidence >= NAME_MATCH, "name_match").otherwise("ambiguous"))


def search_bucket(kind: Column) -> Column:
    """Which group of results a node's kind belongs to."""
    return F.when(kind.isin(*SYMBOLS), "symbols").when(kind == "File", "files").otherwise("directories")


def crosses_repositories(src: Column, dst: Column) -> Column:
    """Whether both are node ids, of different repositories."""
    a, b = F.split(src, ":"), F.split(dst, ":")
    return (F.get(a, F.lit(0)) == "rs1") & (F.get(b, F.lit(0)) == "rs1") & ~F.get(a, F.lit(1)).eqNullSafe(F.get(b, F.lit(1)))


def id_suffix(node_id: Column) -> Column:
    """What follows the repository in an id; null if it isn't one."""
    return F.nullif(F.regexp_extract(node_id, r"^rs1:[^:]+(:.+)$", 1), F.lit(""))


def id_repo(node_id: Column) -> Column:
    return F.nullif(F.regexp_extract(node_id, r"^rs1:([^:]+):.+$", 1), F.lit(""))


def module_var_kind(name: Column) -> Column:
    """const if the name is capitals and underscores only, one capital at least."""
    return F.when(name.rlike("^[A-Z_]*[A-Z][A-Z_]*$"), "const").otherwise("module")


def path_prefixes(path: Column) -> Column:
    """All ancestors of a path and itself, outermost first: a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
