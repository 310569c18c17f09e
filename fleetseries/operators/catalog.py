"""Dataset catalog: parse, visibility, search, facets, summaries, versions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.scalar import ts_lit
from fleetseries.schemas import CONFIG_DOC, DEFAULT_VOCABULARY, TRUE_TEXTS

DECLARED_METADATA = ["title", "institution", "license", "naming_authority", "standard_name_vocabulary"]


def parse_documents(docs: DataFrame) -> DataFrame:
    """(dataset_id, content, optionally source_id) -> one parsed row per document.

    ``parsed_ok`` is false for text that is not a JSON object; such documents
    are skipped by listings and reported by the rules job, the rest survive.
    Consumers that run many checks over the parsed fields should read the
    result as a written table (``catalog_table``): otherwise Catalyst inlines
    the JSON parser into every pushed-down predicate and rule expression.
    """
    parsed = F.from_json("content", CONFIG_DOC, {"mode": "PERMISSIVE"})
    is_object = F.json_object_keys("content").isNotNull()
    kept = ["source_id"] if "source_id" in docs.columns else []
    out = docs.select(*kept, "dataset_id", "content", parsed.alias("doc"), (is_object & parsed.isNotNull()).alias("parsed_ok"))
    return out.select(
        *kept, "dataset_id", "content", F.coalesce("parsed_ok", F.lit(False)).alias("parsed_ok"),
        F.col("doc.source_type").alias("source_type"),
        F.col("doc.access").alias("access"),
        F.col("doc.platform_type").alias("platform_type"),
        F.col("doc.source_config").alias("source_config"),
        F.col("doc.variables").alias("variables"),
        F.col("doc.deployments").alias("deployments"),
        with_metadata_defaults(F.col("doc.metadata")).alias("metadata"),
        F.col("doc.output.file_naming").alias("file_naming"),
        F.coalesce(F.lower("doc.output.publish").isin(TRUE_TEXTS), F.lit(False)).alias("publish"),
        F.col("doc.id").alias("doc_id"),
    )


def catalog_table(docs: DataFrame) -> DataFrame:
    """Parse once and store the catalog (one row per dataset) in the shared
    folder; listings, rules and facets read this table."""
    from fleetseries.session import write_table

    return write_table(parse_documents(docs), "catalog")


def with_metadata_defaults(meta: Column) -> Column:
    """Entries with a value, plus the default vocabulary when not given."""
    m = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")),
                     lambda k, v: v.isNotNull())
    default = F.create_map(F.lit("standard_name_vocabulary"), F.lit(DEFAULT_VOCABULARY))
    return F.when(F.map_contains_key(m, "standard_name_vocabulary"), m).otherwise(F.map_concat(m, default))


def metadata_values_in_order(meta: Column) -> Column:
    """Declared metadata fields first (in declaration order), then other keys sorted."""
    declared = F.array(*[F.lit(k) for k in DECLARED_METADATA])
    extra_keys = F.array_sort(F.array_except(F.map_keys(meta), declared))
    keys = F.concat(declared, extra_keys)
    return F.filter(F.transform(keys, lambda k: F.element_at(meta, k)), lambda v: v.isNotNull())


def standard_names(variables: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(
        F.transform(variables, lambda v: v["standard_name"]), lambda s: s.isNotNull())))


def search_documents(catalog: DataFrame) -> DataFrame:
    """Per dataset: access, platform, lower-cased text blob of id and metadata
    values, set of standard names, metadata map."""
    return catalog.select(
        "dataset_id", "access", "platform_type", "metadata",
        F.lower(F.array_join(F.concat(F.array("dataset_id"), metadata_values_in_order(F.col("metadata"))),
                             " ")).alias("text_blob"),
        standard_names(F.col("variables")).alias("standard_names"),
    )


def visible(df: DataFrame, authenticated: bool = False) -> DataFrame:
    """Restricted datasets are removed for anonymous callers, before anything else."""
    if authenticated:
        return df
    return df.filter(F.col("access") != "restricted")


def match_text(docs: DataFrame, q: str | None) -> DataFrame:
    if not q:
        return docs
    return docs.filter(F.contains(F.col("text_blob"), F.lit(q.lower())))


def match_platform(docs: DataFrame, platform_type: str | None) -> DataFrame:
    if not platform_type:
        return docs
    return docs.filter(F.col("platform_type") == platform_type)


def match_all_names(docs: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Requested standard names must all be among the dataset's names."""
    if not names:
        return docs
    req = F.array(*[F.lit(n) for n in names])
    return docs.filter(F.size(F.array_except(req, F.col("standard_names"))) == 0)


def match_metadata(docs: DataFrame, pairs: Sequence[tuple[str, str]] | None) -> DataFrame:
    """Every (key, value): key present and value a case-insensitive substring."""
    for key, value in pairs or []:
        actual = F.element_at(F.col("metadata"), F.lit(key))
        docs = docs.filter(actual.isNotNull() & F.contains(F.lower(actual), F.lit(value.lower())))
    return docs


def facet_names(visible_docs: DataFrame) -> DataFrame:
    return visible_docs.select(F.explode("standard_names").alias("standard_name")).distinct()


def facet_keys(visible_docs: DataFrame) -> DataFrame:
    return visible_docs.select(F.explode(F.map_keys("metadata")).alias("metadata_key")).distinct()


def config_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.sha2(F.col("content"), 256))


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object sorted, no blanks, and exact decimals without trailing zeros.

    The keys of a variant object are stored in order, so rendering the parsed
    value sorts at every depth; text that is no JSON gives null.
    """
    return F.to_json(F.try_parse_json(text))


def config_hash_sorted(docs: DataFrame) -> DataFrame:
    """A hash that ignores the order of keys and the writing of numbers and blanks; of the bytes where the text is no JSON."""
    return docs.withColumn("hash", F.sha2(F.coalesce(canonical_json(F.col("content")), F.col("content")), 256))


def current_version(versions: DataFrame) -> DataFrame:
    """Newest version per dataset by ``created_at``, then ``version_id``.
    ``max_by`` is a plain aggregate: partial per task, no per-dataset sort."""
    v = versions.groupBy("dataset_id").agg(
        F.max_by(F.struct("version_id", "hash", "content", "created_at"),
                 F.struct("created_at", "version_id")).alias("v")
    )
    return v.select("dataset_id", "v.*")


def config_changes(current: DataFrame, incoming: DataFrame, now: datetime | str) -> DataFrame:
    """New version rows for documents whose hash differs from the current one
    (or that have no version yet)."""
    cur = current.select("dataset_id", F.col("hash").alias("_cur_hash"),
                         F.col("version_id").alias("_cur_id"))
    joined = incoming.join(cur, on="dataset_id", how="left")
    return joined.filter(~F.col("hash").eqNullSafe(F.col("_cur_hash"))).select(
        "dataset_id", "hash", "content",
        ts_lit(now).alias("created_at"),
        F.col("_cur_id").isNull().alias("is_first"),
    )


def dataset_summaries(catalog: DataFrame, positions: DataFrame) -> DataFrame:
    """Listing entry per dataset: title, institution, platform_type, standard_names, all metadata, current position.

    ``positions``: (dataset_id, lat, lon, elevation) of fixed platforms (``deployment.current_position``).
    """
    out = catalog.join(positions.select("dataset_id", "lat", "lon", "elevation"), "dataset_id", "left")
    return out.select(
        "dataset_id", F.element_at("metadata", "title").alias("title"), F.element_at("metadata", "institution").alias("institution"),
        "platform_type", standard_names(F.col("variables")).alias("standard_names"), "metadata", "lat", "lon", "elevation")


def dataset_details(catalog: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per dataset: its variables (name, standard_name, units, dtype, raw names) and deployments in
    declared order, metadata, and the time its data cover (null without data).

    ``coverage``: (dataset_id, data_start, data_end).
    """
    def variable(v):
        members = F.transform(F.coalesce(v["members"], F.array()), lambda m: m["raw_name"])
        plain = F.concat(F.array(v["raw_name"]), F.coalesce(v["old_names"], F.array().cast("array<string>")))
        return F.struct(
            F.coalesce(v["standard_name"], v["raw_name"]).alias("name"), v["standard_name"].alias("standard_name"), v["units"].alias("units"),
            F.coalesce(v["dtype"], F.lit("numeric")).alias("dtype"),
            F.when(v["extra_dimension"].isNotNull(), members).otherwise(plain).alias("raw_names"))

    out = catalog.join(coverage.select("dataset_id", "data_start", "data_end"), "dataset_id", "left")
    return out.select("dataset_id", "platform_type", "source_type", "metadata", F.transform("variables", variable).alias("variables"),
                      "deployments", "data_start", "data_end")
