"""Names, paths, sizes and token lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_size(size: Column, separator: str = "*") -> Column:
    """``'832*480'`` to STRUCT<width, height>; null parts when it does not parse."""
    parts = F.split(size, "[" + separator + "]", 2)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.struct(number(0).alias("width"), number(1).alias("height"))


def normalize_tokens(value: Column, aliases: Mapping[str, str], allowed: Sequence[str]) -> Column:
    """STRUCT<tokens, valid>: trimmed, lower-case, aliased and de-duplicated in order of first use.

    Takes a comma-separated string; give an array as ``F.array_join(col, ',')``.
    """
    renames = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else None

    def rename(token: Column) -> Column:
        clean = F.lower(F.trim(token))
        return clean if renames is None else F.coalesce(F.try_element_at(renames, clean), clean)

    tokens = F.array_distinct(F.transform(F.split(value, ","), rename))
    known = F.forall(tokens, lambda t: t.isin(*allowed))
    valid = F.coalesce((F.size(tokens) > 0) & known, F.lit(False))
    return F.struct(F.when(valid, tokens).alias("tokens"), valid.alias("valid"))


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def path_parts(path: Column) -> Column:
    """Sort key that orders by path part, as a file tree is listed."""
    return F.split(path, "/")


def manifest_path(name: Column, directory: str | None = None) -> Column:
    document = F.concat(path_stem(name), F.lit(".manifest.json"))
    return document if directory is None else F.concat(F.lit(directory.rstrip("/") + "/"), document)


def output_name(explicit: Column, default_suffix: str = ".mp4") -> Column:
    """An explicit name, with the default suffix when it has none."""
    has_suffix = path_name(explicit).rlike(r"(?<=.)\.[^.]+$")
    return F.when(has_suffix, explicit).otherwise(F.concat(explicit, F.lit(default_suffix)))


def cache_key(fields: Mapping[str, Column], length: int = 32) -> Column:
    """Leading hex digits of the SHA-256 of canonical JSON: keys sorted, nulls kept, no spaces."""
    ordered = F.struct(*(fields[name].alias(name) for name in sorted(fields)))
    document = F.to_json(ordered, {"ignoreNullFields": "false"})
    return F.substring(F.sha2(document, 256), 1, length)
