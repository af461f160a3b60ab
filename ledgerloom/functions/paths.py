"""Functions on paths, routes and links as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest relative path, most cited files of one text.
LONGEST, CITED = 200, 20


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def is_relative(path: Column) -> Column:
    """A path inside a repository: not absolute, no parent step, backslash, drive letter or control character."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)|\\|^[A-Za-z]:|[\x00-\x1f]") & (F.length(path) <= LONGEST) & (path != "")


def cited_files(text: Column) -> Column:
    """Distinct file names with an extension, in the order in which they appear."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_/-]+\.[a-z]{2,4}\b"), F.lit(0))), 1, CITED)


def route_parts(path: Column) -> Column:
    """Segments of a route in lower case; `:x`, `{x}` and `[x]` are parameters, all alike."""
    plain = F.lower(F.regexp_replace(path, r":(\w+)|\{(\w+)\}|\[(\w+)\]", ":p"))
    return F.filter(F.split(plain, "/", -1), lambda s: s != "")


def route_similarity(a: Column, b: Column) -> Column:
    """Twice the aligned equal segments over all segments; 0 if either has none."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n == 0, 0.0).otherwise(2 * same / (F.size(a) + F.size(b)))


def file_route(path: Column) -> Column:
    """The route that a file under pages/ or app/ serves by its place; null for other files."""
    inner = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(^|/)(pages|app)/(.+?)/?(route|page|index)?\.(ts|tsx|js|jsx)$", 3)
    return F.when(inner != "", F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(inner, r"\[(\w+)\]", ":$1"), "/index$", "")))


def relative_module(dots: Column, module: Column) -> Column:
    """What a module with leading dots stands for: one dot is the folder itself, each further one a folder up."""
    up = F.when(dots <= 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), dots - 1))
    return F.concat(up, F.replace(module, F.lit("."), F.lit("/")))


def signature(text: Column, line: Column) -> Column:
    """Up to four lines from a line on, joined, up to the first `=>` or `{` (or the colon that ends a def); 120 characters."""
    lines = F.transform(F.slice(F.split(text, "\n", -1), F.greatest(line, F.lit(1)), F.lit(4)), F.trim)
    joined = F.array_join(lines, " ")
    cut = F.regexp_extract(joined, r"^(.*?)(=>|\{|$)", 1)
    # A def ends with the first of its lines that ends with a colon.
    upto = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: F.element_at(lines, k).endswith(":") & F.array_join(F.slice(lines, F.lit(1), k), " ").rlike(r"\bdef\s"))
    body = F.array_join(F.slice(lines, F.lit(1), F.element_at(upto, 1)), " ")
    until = F.when((F.size(upto) > 0) & ~body.rlike(r"=>|\{"), F.regexp_replace(body, r":\s*$", "")).otherwise(cut)
    clean = F.trim(F.regexp_replace(F.regexp_replace(until, r"^(export\s+|default\s+)+", ""), r"\s+", " "))
    short = F.when(F.length(clean) > 120, F.concat(F.substring(clean, 1, 117), F.lit("…"))).otherwise(clean)
    return F.when((line >= 1) & (line <= F.size(F.split(text, "\n", -1))) & (short != ""), short)


def remote_name(url: Column) -> Column:
    """host/path of a repository's address, without scheme, user, port, www., query and .git; null if it has no such shape."""
    out = F.lower(F.trim(url))
    # What goes, in this order.
    for pattern, put in ((r"[?#].*$", ""), (r"^[a-z][a-z0-9+.-]*://", ""), (r"^[^@/]+@", ""), (r"^([^/:]+):[0-9]+(/|$)", "$1$2"), (r"^([^/:]+):/?", "$1/"), (r"^www\.", ""), (r"^ssh\.dev\.azure\.com/v3/", "dev.azure.com/"), (r"/_git/", "/"), (r"/{2,}", "/"), (r"/+$", ""), (r"\.git$", ""), (r"/+$", "")):
        out = F.regexp_replace(out, pattern, put)
    return F.when(out.rlike(r"^([a-z0-9-]+(\.[a-z0-9-]+)+|localhost)(/[^/\s]+){2,}$"), out)


def repository_slug(url: Column) -> Column:
    """The last two segments of an address, other signs than letters, digits, `.`, `_` and `-` as `__`."""
    return F.regexp_replace(F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(\.git)?$", 1), "[^a-zA-Z0-9._-]+", "__")


def aliased(path: Column, aliases: dict[str, str]) -> Column:
    """The path with its longest matching prefix replaced; null where none matches."""
    out = F.lit(None).cast("string")
    for prefix in sorted(aliases, key=len):
        out = F.when(path.startswith(prefix), F.concat(F.lit(aliases[prefix]), F.substring(path, len(prefix) + 1, 1 << 30))).otherwise(out)
    return out


def line_of(text: Column, offset: Column) -> Column:
    """Number of the line that holds a place (from 1)."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def normalised(path: Column) -> Column:
    """The path without empty, `.` and `..` steps."""
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def absolute(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` steps."""
    return F.concat(F.lit("/"), normalised(path))
