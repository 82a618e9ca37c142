"""Path algebra as column expressions. Keys use forward slashes and have no trailing one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone, unlike ``lower``."""
    return F.translate(text, UPPER, LOWER)


def path_key(path: Column) -> Column:
    """Backslashes to slashes, trailing slashes off unless the path is one character."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")


def windows_key(path: Column) -> Column:
    """Key of a Windows path: extended prefixes off, doubled slashes collapsed, lower case; drive roots keep theirs."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    plain = F.regexp_replace(F.regexp_replace(slashed, "^//[?]/UNC/", "//"), "^//[?]/", "")
    flat = F.lower(F.regexp_replace(plain, "(?<=.)/{2,}", "/"))
    return F.when(flat.rlike("^[a-z]:/+$"), flat).otherwise(F.regexp_replace(flat, "(?<=.)/+$", ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda s: s != "")


def ancestors(key: Column) -> Column:
    """The key and all directories above it, the topmost first; joins on it replace prefix comparisons."""
    each = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.transform(F.array(segments(key)), each)[0]  # so that the key is cut once, not once for each ancestor


def directory(key: Column) -> Column:
    """The directory whose ancestors, itself among them, are those of ``ancestors`` but the key itself; null where there are none."""
    above = F.left(key, F.length(key) - F.length(F.substring_index(key, "/", -1)) - 1)
    whole = F.concat(F.lit("/"), F.array_join(segments(key), "/"))  # of a key with empty segments, which is none of its ancestors
    return F.when(~key.rlike(r"\\|//|/$|^$|^[^/]"), F.nullif(above, F.lit(""))).otherwise(F.nullif(whole, key))


def parent_key(key: Column) -> Column:
    """Up to the last slash; null at a root or without a slash."""
    return F.when((key == "/") | ~key.contains("/"), F.lit(None).cast("string")).when(key.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(key, "^(.*)/[^/]*$", 1))


def covers(root: Column, key: Column) -> Column:
    """Whether ``key`` is ``root`` or below it; segments are never split."""
    return (key == root) | F.when(root == "/", key.startswith("/")).otherwise(F.startswith(key, F.concat(root, F.lit("/"))))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def effective_extension(name: Column, extension: Column) -> Column:
    """The given extension without leading dots, else what follows the name's last dot."""
    return F.coalesce(F.regexp_replace(extension, r"^\.+", ""), F.nullif(F.regexp_extract(name, r"\.([^.]*)$", 1), F.lit("")))


def own_extension(name: Column) -> Column:
    """Lower-case extension of a file name; dot-files have none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)), F.lit(""))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob in which * and ? cross slashes and **/ stands for any directories."""
    out, k = "", 0
    while k < len(pattern):
        rest = pattern[k:]
        if rest.startswith("**/"):
            out, k = out + "(?:.*/)?", k + 3
        elif rest.startswith("*"):
            out, k = out + ".*", k + len(rest) - len(rest.lstrip("*"))
        elif rest.startswith("?"):
            out, k = out + ".", k + 1
        elif found := re.match(r"\[(!?)([^\]]+)\]", rest):
            out, k = out + f"[{'^' if found[1] else ''}{found[2]}]", k + found.end()
        elif found := re.match(r"\{([^{}]*)\}", rest):
            out, k = out + "(?:" + "|".join(map(re.escape, found[1].split(","))) + ")", k + found.end()
        else:
            out, k = out + re.escape(rest[0]), k + 1
    return f"^(?s:{out})$"
