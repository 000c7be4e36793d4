"""Path algebra and glob patterns as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(path: Column) -> Column:
    """Lower case; letters, digits and slashes stay, apostrophes vanish, anything else becomes one space; no space beside a slash or at the end."""
    plain = F.regexp_replace(F.replace(F.lower(path), F.lit("'"), F.lit("")), r"[^\p{IsAlphabetic}\p{N}/]+", " ")
    return F.trim(F.regexp_replace(plain, " ?/[ /]*", "/"))


def lexical_normalize(path: Column) -> Column:
    """Without empty and "." components; ".." takes back a component where there is one and is dropped at the root."""
    parts = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, c: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when(c != "..", F.concat(done, F.array(c)))
            .when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .when(rooted, done)
            .otherwise(F.concat(done, F.array(c)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def absolute(root: Column, path: Column) -> Column:
    """A stored path seen from its root, normalized; the result must be absolute."""
    full = lexical_normalize(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path)))
    wrong = F.raise_error(F.concat(F.lit("not an absolute path: "), full)).cast("string")
    return F.when(F.startswith(full, F.lit("/")), full).when(full.isNotNull(), wrong)


def relative_to(path: Column, base: Column) -> Column:
    """The way from ``base`` to ``path``, both absolute and normalized."""
    parts = F.filter(F.split(path, "/"), lambda c: c != "")
    start = F.filter(F.split(base, "/"), lambda c: c != "")
    both = F.least(F.size(parts), F.size(start))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: (i > both) | (F.try_element_at(parts, i) != F.try_element_at(start, i)))
    common = F.least(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, both), both)
    up = F.array_repeat(F.lit(".."), F.size(start) - common)
    return F.array_join(F.concat(up, F.slice(parts, common + 1, F.size(parts))), "/")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension; empty for names without one, and for those that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def glob_regex(glob: str) -> str:
    """An anchored regular expression: * stays inside a component, ** crosses them, ? is one character, [..] and {a,b} as usual."""
    out, k, depth = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if glob.startswith("/**", k) and k + 3 == len(glob):
            out.append("/.*")
            k += 3
            continue
        if c == "*":
            out.append("[^/]*")
            k += 2 if glob.startswith("**", k) else 1
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", k + 2)
            if end < 0:
                raise ValueError(f"unclosed character class in {glob!r}")
            body = glob[k + 1 : end]
            out.append("[" + ("^" if body[0] in "!^" else "") + re.sub(r"([\\\[\]&~])", r"\\\1", body.lstrip("!^")) + "]")
            k = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out.append(re.escape(glob[k]))
        else:
            out.append(re.escape(c))
        k += 1
    if depth:
        raise ValueError(f"unclosed alternation in {glob!r}")
    return "^" + "".join(out) + "$"


def excluded(path: Column, globs) -> Column:
    """Whether any glob fits: the name where the glob has no slash, else the whole path."""
    out = F.lit(False)
    for glob in globs:
        out = out | (path if "/" in glob else file_name(path)).rlike(glob_regex(glob))
    return out


def in_excluded_tree(path: Column, root: str, globs) -> Column:
    """Whether the file or a directory on the way to it, from ``root`` on, is excluded."""
    depth = len([c for c in root.split("/") if c])
    parts = F.filter(F.split(path, "/"), lambda c: c != "")
    ways = F.transform(
        F.sequence(F.lit(max(depth, 1)), F.greatest(F.size(parts), F.lit(max(depth, 1)))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return F.exists(ways, lambda p: excluded(p, globs))
