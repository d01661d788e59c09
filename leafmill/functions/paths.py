"""References and paths inside packages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(ref) -> Column:
    return F.lower(F.regexp_extract(ref, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def is_external(ref) -> Column:
    """Has a scheme or a host."""
    return (scheme(ref) != "") | F.startswith(ref, F.lit("//"))


def is_remote(ref) -> Column:
    return scheme(ref).isin("http", "https")


def unquoted(c) -> Column:
    """%-escapes decoded; + stays, and so does a % that begins no escape."""
    whole = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(whole), c)


def path_of(ref) -> Column:
    """The path of a reference without query and fragment, decoded."""
    return unquoted(F.regexp_replace(ref, r"[?#].*$", ""))


def folder(path) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal(path: Column) -> Column:
    """Without . and .. parts, as POSIX normal paths are; an empty path is a dot."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(path, F.lit("/"))

    def step(done, part):
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        drop = up | ((part == "..") & (F.size(done) == 0) & rooted)
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(drop, done).otherwise(F.concat(done, F.array(part)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(F.size(done) == 0, F.when((p == "..") & rooted, done).otherwise(F.array(p))).otherwise(step(done, p))), "/")
    whole = F.concat(F.when(rooted, "/").otherwise(""), folded)
    return F.when(whole == "", ".").otherwise(whole)


def resolved(base_folder, ref) -> Column:
    """A reference from a document in ``base_folder`` as a member path."""
    target = path_of(ref)
    return normal(F.when((base_folder == "") | F.startswith(target, F.lit("/")), target).otherwise(F.concat(base_folder, F.lit("/"), target)))
