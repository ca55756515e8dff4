"""Path and file-name expressions with POSIX rules."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name endings taken as audio.
AUDIO_EXTENSIONS = ["mp3", "wav", "flac", "ogg", "m4a", "aac"]


def is_audio(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(AUDIO_EXTENSIONS) + r")\z")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalise_path(path: Column) -> Column:
    """Collapse ``//``, ``.`` and ``..``; exactly two leading slashes are kept."""
    absolute = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        size = F.size(kept)
        can_pop = (size > 0) & (F.coalesce(F.get(kept, size - 1), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), kept)
            .when(part != "..", F.array_append(kept, part))
            .when(can_pop, F.slice(kept, F.lit(1), F.greatest(size - 1, F.lit(0))))
            .when(absolute, kept)
            .otherwise(F.array_append(kept, part))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    root = (
        F.when(path.startswith("//") & ~path.startswith("///"), F.lit("//"))
        .when(absolute, F.lit("/"))
        .otherwise(F.lit(""))
    )
    full = F.concat(root, F.array_join(parts, "/"))
    # Most paths hold none of these; the branch keeps them out of the array work.
    plain = (path != "") & ~path.rlike(r"//|(^|/)\.\.?(/|$)|/$")
    return F.when(plain, path).otherwise(F.when(full == "", F.lit(".")).otherwise(full))


def host_path(path: Column, source_root: str, host_root: str, strict_prefix: bool = False) -> Column:
    """Rewrite a path below ``source_root`` to the same place below ``host_root``.

    The prefix test looks at characters, so ``/music2/a`` counts as below ``/music`` and
    becomes ``<host>/../music2/a``; ``strict_prefix`` leaves such paths alone.
    """
    source_root, host_root = source_root.rstrip("/"), host_root.rstrip("/")
    if not source_root or not host_root:
        return path
    root = posixpath.normpath(source_root)
    normal = normalise_path(path)
    rest = F.substring(normal, len(root) + 1, 2**31 - 1)
    sibling = F.lit("../" + posixpath.basename(root))
    relative = (
        F.when(rest == "", F.lit("."))
        .when(rest.startswith("/"), F.substring(rest, 2, 2**31 - 1))
        .otherwise(F.concat(sibling, rest))
    )
    inside = normal.startswith(root)
    if strict_prefix:
        inside = inside & ((rest == "") | rest.startswith("/"))
    return F.when(inside, F.concat(F.lit(host_root + "/"), relative)).otherwise(normal)


def sanitise_name(name: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` only; runs of ``_`` collapse, outer ones go."""
    cleaned = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
    return F.btrim(F.regexp_replace(cleaned, "_+", "_"), F.lit("_"))


def file_key(path: Column, length: Column, modified_micros: Column) -> Column:
    """Content key: basename, size and modification time; md5 of the path without them."""
    stamped = F.concat(
        basename(path), F.lit("_"), length.cast("string"), F.lit("_"), modified_micros.cast("string")
    )
    return F.coalesce(stamped, F.md5(path))
