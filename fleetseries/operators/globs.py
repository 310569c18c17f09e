"""Matching a file listing against thousands of glob patterns.

A pattern is turned into an anchored regex by expressions. Trying every
pattern on every file would be a cross join, so each pattern is filed under a
literal text that all its matches contain at a known place: the literal start
of its path or of its file name, whichever is longer. A file looks up its own
starts of those lengths (the levels of a prefix trie) by equi-join, and the
regex decides among what it meets.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseries.schemas import BACKUP_EXTENSION_PREFIX, HISTORICAL_SUFFIX

# `**/`, `*`, `?`, a class, or a literal run
_TOKEN = r"(\*\*/|\*+|\?|\[!?\]?[^\]/]*\]|[^*?\[]+|\[)"
_LITERAL = r"^([^*?\[]*)"


def pattern_family(file_pattern: str, historical_suffix: str = HISTORICAL_SUFFIX) -> list[str]:
    """Live pattern, archived pattern (suffix before the extension), backups."""
    stem, ext = os.path.splitext(file_pattern)
    return [file_pattern, stem + historical_suffix + ext, file_pattern + BACKUP_EXTENSION_PREFIX + "*"]


def glob_regex(pattern: Column) -> Column:
    """A glob as a regex without anchors: ``*`` and ``?`` stay within a path segment, ``**/`` spans
    segments, ``[...]`` and ``[!...]`` are classes, anything else is literal."""

    def piece(t: Column) -> Column:
        negated = F.startswith(t, F.lit("[!"))
        body = F.substr(t, F.when(negated, 3).otherwise(2), F.length(t) - F.when(negated, 3).otherwise(2))
        inside = F.regexp_replace(body, r"([\\\[\]&^])", r"\\$1")
        return (
            F.when(t == "**/", "(?:[^/]+/)*")
            .when(F.startswith(t, F.lit("*")), "[^/]*")
            .when(t == "?", "[^/]")
            .when(F.startswith(t, F.lit("[")) & (F.length(t) > 2), F.concat(F.when(negated, "[^/").otherwise("["), inside, F.lit("]")))
            .otherwise(F.regexp_replace(t, r"([.+()^$|{}\\\[\]?*])", r"\\$1"))
        )

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(1)), piece), "")


def split_extension(path: Column) -> tuple[Column, Column]:
    """Path without its last extension, and the extension (leading dots of the name start none)."""
    ext = F.regexp_extract(path, r"^(?:.*/)?\.*[^/.][^/]*(\.[^/.]*)$", 1)
    return F.substr(path, F.lit(1), F.length(path) - F.length(ext)), ext


def family_regex(file_pattern: Column, historical_suffix: Column) -> Column:
    """One anchored regex that matches any member of the pattern family."""
    stem, ext = split_extension(file_pattern)
    members = [
        glob_regex(file_pattern),
        glob_regex(F.concat(stem, historical_suffix, ext)),
        F.concat(glob_regex(file_pattern), glob_regex(F.lit(BACKUP_EXTENSION_PREFIX + "*"))),
    ]
    return F.concat(F.lit("^(?:"), F.concat_ws("|", *members), F.lit(")$"))


class PatternIndex:
    """Pattern families (dataset_id, file_pattern, historical_suffix) filed under their literal starts."""

    def __init__(self, patterns: DataFrame):
        stem, _ = split_extension(F.col("file_pattern"))
        in_path = F.regexp_extract(stem, _LITERAL, 1)
        in_name = F.regexp_extract(F.regexp_extract(stem, r"([^/]*)$", 1), _LITERAL, 1)
        by_name = F.length(in_name) > F.length(in_path)
        self.patterns = patterns.select(
            "dataset_id", "historical_suffix",
            family_regex(F.col("file_pattern"), F.col("historical_suffix")).alias("_regex"),
            by_name.alias("_by_name"), F.when(by_name, in_name).otherwise(in_path).alias("_start"),
        )

    def match(self, files: DataFrame) -> DataFrame:
        """Files (rel_path, other columns) with the dataset_id and suffix of each family that they match."""
        # the distinct lengths of the starts: at most as many as a path has characters
        levels = self.patterns.select("_by_name", F.length("_start").alias("n")).distinct().collect()
        name = F.regexp_extract("rel_path", r"([^/]*)$", 1)
        starts = [
            F.when(F.length(text) >= r["n"], F.struct(F.lit(r["_by_name"]).alias("_by_name"), F.substring(text, 1, r["n"]).alias("_start")))
            for r in levels for text in [name if r["_by_name"] else F.col("rel_path")]
        ]
        if not starts:
            return files.join(self.patterns.select("dataset_id", "historical_suffix"), F.lit(False))
        keyed = files.withColumn("_key", F.explode(F.filter(F.array(*starts), lambda s: s.isNotNull())))
        keyed = keyed.select(*files.columns, "_key._by_name", "_key._start")
        met = keyed.join(self.patterns, ["_by_name", "_start"])
        return met.filter(F.regexp_like("rel_path", F.col("_regex"))).select(*files.columns, "dataset_id", "historical_suffix")
