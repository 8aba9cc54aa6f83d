"""Functions of paths, module names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and words that mean tests, and directories that indexing skips.
TEST_DIRS = ("test", "tests", "testing")
TEST_WORDS = ("test", "spec", "fixture", "conftest", "测试", "用例")
SKIPPED_DIRS = (".git", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", "build", "dist")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def is_test_path(path: Column) -> Column:
    """Whether a file lies in a directory of tests or is named like one; whole names only, so latest.py is none."""
    p = parts(F.lower(path))
    name = F.element_at(p, -1)
    return F.exists(F.slice(p, 1, F.greatest(F.lit(0), F.size(p) - 1)), lambda d: d.isin(*TEST_DIRS)) | (name == "conftest.py") | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))


def is_about_tests(query: Column) -> Column:
    return F.regexp_like(F.lower(query), F.lit("|".join(TEST_WORDS)))


def is_skipped(path: Column) -> Column:
    """Whether any directory above a file is one that indexing skips."""
    p = parts(path)
    return F.exists(F.slice(p, 1, F.greatest(F.lit(0), F.size(p) - 1)), lambda d: d.isin(*SKIPPED_DIRS))


def module_name(path: Column) -> Column:
    """The dotted module of a file; a package's own file is the package, at the root __init__."""
    dotted = F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def relative_base(module: Column, level: Column, name: Column) -> Column:
    """What a relative import names: the module without its last `level` parts, then the name, if any."""
    p = F.split(module, r"\.")
    kept = F.slice(p, 1, F.greatest(F.lit(0), F.size(p) - level))
    return F.concat_ws(".", F.array_join(kept, "."), F.when(F.coalesce(name, F.lit("")) != "", name)) if name is not None else F.array_join(kept, ".")


def prefixes(dotted: Column) -> Column:
    """All dotted prefixes, the longest first: a.b.c, a.b, a."""
    p = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(p, 1, n), "."))


def normalise(path: Column) -> Column:
    """A path below the root: slashes, no dots, .. resolved; null where it is absolute, empty or leaves the root."""
    p = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda acc, x: (
        F.when(acc.isNull(), acc).when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>")).when(x == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, x))
    )
    done = F.aggregate(p, F.array().cast("array<string>"), step)
    bad = F.startswith(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")) | F.regexp_like(path, F.lit(r"^[A-Za-z]:"))
    return F.when(~bad & done.isNotNull(), F.array_join(done, "/"))


def terminal(dotted: Column) -> Column:
    """The last dotted part."""
    return F.element_at(F.split(dotted, r"\."), -1)


def base_url(url: Column) -> Column:
    """Scheme and host in lower case, no outer blanks, no slash or .git at the end."""
    t = F.trim(url)
    head = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    rest = F.substr(t, F.length(head) + 1)
    return F.concat(head, F.regexp_replace(F.regexp_replace(rest, r"/+$", ""), r"\.git$", ""))


def url_variants(url: Column) -> Column:
    """The spellings under which a repository may be known: as given, and with and without .git and slash."""
    b = base_url(url)
    trimmed = F.when(F.endswith(F.regexp_replace(F.trim(url), r"/+$", ""), F.lit(".git")), F.concat(b, F.lit(".git"))).otherwise(b)
    return F.array_distinct(F.array(url, trimmed, b, F.concat(b, F.lit(".git")), F.concat(b, F.lit("/"))))


def repo_slug(url: Column) -> Column:
    """owner/name of an address in either form; null where there is none."""
    m = F.regexp_extract(F.trim(url), r"^(?:git@[^:/\s]+:|[A-Za-z+]+://(?:[^@/\s]+@)?[^/\s]+/)([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.when(m != "", m)


def is_acceptable_url(url: Column, hosts: tuple[str, ...] = ()) -> Column:
    """Whether an address may be fetched as far as text can tell: http(s), no login in it, a named host that is allowed and not private."""
    t = F.trim(url)
    host = F.lower(F.regexp_extract(t, r"^https?://(?:[^@/]*@)?([^/:?#]*)", 1))
    private = F.regexp_like(host, F.lit(r"^(?:localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2\d|3[01])\..*|0\..*|\[.*)$"))
    ok = F.regexp_like(t, F.lit(r"^https?://")) & ~F.regexp_like(t, F.lit(r"^https?://[^/]*@")) & (host != "") & ~private & (F.length(t) <= 2048)
    return F.coalesce(ok & host.isin(*hosts) if hosts else ok, F.lit(False))
