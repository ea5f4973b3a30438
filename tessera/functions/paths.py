"""Path functions as Column expressions; all stay inside the generated code of a stage."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import rounded

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)
    return found if default is None else F.coalesce(found, default)


def posix(path: Text) -> Column:
    """Forward slashes, without a leading folder that is named like an archive."""
    return F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"^[^/]+\.zip/", "")


def basename(path: Text) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Text) -> Column:
    """Last ``.ext`` of the name in lower case; names that begin with their only dot, or end with one, have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Text) -> Column:
    return _lookup(config.LANGUAGES, extension(path), F.lit("Unknown"))


def fence(of_language: Text) -> Column:
    return _lookup(config.FENCES, _col(of_language), F.lit(""))


def icon(path: Text) -> Column:
    return _lookup(config.ICONS, language(path), F.lit(config.DEFAULT_ICON))


def language_context(path: Text) -> Column:
    """struct(language, fence, is_code, is_config, is_markup)"""
    ext, lang = extension(path), language(path)
    is_config, is_markup = ext.isin(*config.CONFIG_EXTENSIONS), ext.isin(*config.MARKUP_EXTENSIONS)
    is_code = ~is_config & ~is_markup & (lang != "Unknown")
    return F.struct(lang.alias("language"), fence(lang).alias("fence"), is_code.alias("is_code"), is_config.alias("is_config"), is_markup.alias("is_markup"))


def role(path: Text) -> Column:
    """What a file is for, by its name, else by its path; null if nothing tells."""
    low = F.lower(_col(path))
    by_path = reduce(lambda out, r: out.when(F.contains(low, F.lit(r[0])), r[1]), config.PATH_ROLES, F.when(F.lit(False), F.lit(None).cast("string")))
    return F.coalesce(_lookup(config.ROLES, F.lower(basename(path))), by_path)


def readable(path: Text) -> Column:
    """Whether a file is to be read: a supported extension, none to skip, and no skipped folder on the (relative) path."""
    ext = extension(path)
    parts = F.split(_col(path), "/")
    return ~ext.isin(*config.SKIPPED_EXTENSIONS) & ext.isin(*config.SUPPORTED_EXTENSIONS) & ~F.arrays_overlap(parts, F.array(*map(F.lit, config.SKIPPED_DIRS)))


def collection_name(name: Text) -> Column:
    """Name made safe: letters, digits and single hyphens, 63 characters at most, ``-qa`` added below 3, lower case."""
    safe = F.regexp_replace(F.regexp_replace(_col(name), "[^a-zA-Z0-9-]", "-"), "-+", "-")
    cut = F.substring(F.regexp_replace(safe, "^-+|-+$", ""), 1, 63)
    return F.lower(F.when(F.length(cut) < 3, F.concat(cut, F.lit("-qa"))).otherwise(cut))


def size_kb(n_bytes: Text) -> Column:
    return rounded(_col(n_bytes) / F.lit(1024.0), 2)


def prefixes(path: Text) -> Column:
    """array of struct(depth, prefix, name, is_file): every folder of a path, and the file."""
    parts = F.split(_col(path), "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), F.get(parts, i - 1).alias("name"), (i == n).alias("is_file")))
