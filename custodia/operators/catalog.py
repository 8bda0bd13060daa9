"""The catalog of labels and datasources: entities, edges, lineage and their synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming, wire
from ..functions.values import first_truthy
from ..session import checkpointed


def select_labels(classifications: DataFrame, limit: int = 0) -> DataFrame:
    """Only entries of type label; ``limit`` keeps the first of them by position (0 keeps all)."""
    labels = classifications.filter(F.upper("type") == "LABEL")
    return labels.orderBy("pos").limit(limit) if limit > 0 else labels


def datasource_item(datasource: Column) -> Column:
    """The facts kept of a datasource; a missing name falls back to the id."""
    connector = datasource["connector"]
    ident = datasource["id"].cast("string")
    return F.struct(
        ident.alias("id"),
        first_truthy(datasource["name"], ident).alias("name"),
        F.coalesce(connector["type"], F.lit("")).alias("connector_type"),
        F.nullif(connector["name"], F.lit("")).alias("connector_name"),
        first_truthy(connector["id"].cast("string"), connector["connectorId"].cast("string")).alias("connector_id"),
    )


def label_datasources(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Which datasources hold how many files of which label: ``label_pos, label_id, ds, document_count``.

    ``files``: pos, datasource, labels (id, name). ``labels``: pos, id, name. Files are matched by
    label id; a label that finds nothing by id is tried by name. Of one datasource the first file
    decides what is known of it.

    Files are read once and reduced to one row per label and datasource; that small table and the result are
    checkpointed, and nothing after it grows with the files.
    """
    tagged = files.filter("datasource.id IS NOT NULL").select(
        "pos", datasource_item(F.col("datasource")).alias("ds"), F.explode(F.array_distinct("labels")).alias("label")
    )
    seen = tagged.groupBy(
        F.col("label.id").cast("string").alias("seen_id"), F.col("label.name").alias("seen_name"), F.col("ds.id").alias("ds_id")
    ).agg(F.min_by("ds", "pos").alias("ds"), F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    seen = checkpointed(seen)
    wanted = labels.select(F.col("pos").alias("label_pos"), F.col("id").cast("string").alias("label_id"), F.col("name").alias("label_name"))

    by_id = wanted.join(seen, F.col("label_id") == F.col("seen_id"))
    missed = wanted.join(seen.select("seen_id"), F.col("label_id") == F.col("seen_id"), "left_anti")
    by_name = missed.filter("label_name <> ''").join(seen, F.col("label_name") == F.col("seen_name"))
    found = by_id.unionByName(by_name).groupBy("label_pos", "label_id", "ds_id")
    one = found.agg(F.min_by("ds", "first_pos").alias("ds"), F.sum("n").alias("document_count"))
    return checkpointed(one.select("label_pos", "label_id", "ds", "document_count"))


def unique_datasources(pairs: DataFrame) -> DataFrame:
    """Every datasource once, as its last label saw it."""
    last = pairs.groupBy(F.col("ds.id").alias("ds_id")).agg(F.max_by("ds", "label_pos").alias("ds"))
    return last.select("ds.*")


def hit_counts(files: DataFrame) -> DataFrame:
    """Documents per datasource and label."""
    tagged = files.select("file_id", "datasource_id", F.explode(F.array_distinct("labels")).alias("label"))
    return tagged.groupBy("datasource_id", "label").agg(F.count("*").alias("document_count"))


def by_collection(datasources: DataFrame, refs: DataFrame) -> DataFrame:
    """Datasources with the collection they belong to and how many it has; those without are dropped.

    The result is one row per datasource, not one list per collection, so a collection may be of
    any size.
    """
    placed = checkpointed(datasources.join(refs, "id").filter("collection_ref <> ''"))
    sizes = checkpointed(placed.groupBy("collection_ref").agg(F.count("*").alias("collection_size")))
    return placed.join(sizes, "collection_ref")


def collection_refs(datasources: DataFrame) -> DataFrame:
    ref = naming.collection_ref(F.coalesce("name", "id"), F.col("id"))
    return datasources.select("id", ref.alias("collection_ref"))


def label_entities(labels: DataFrame, tenant: str, link_base: str) -> DataFrame:
    """Catalog entities of the labels."""
    ident = F.col("id").cast("string")
    own_tenant = first_truthy(F.col("tenant"), F.lit(tenant))
    return labels.select(
        F.lit(wire.DATASET_TYPE).alias("type_name"),
        naming.tag_qn(own_tenant, ident).alias("qualified_name"),
        first_truthy(F.col("name"), F.concat(F.lit(wire.LABEL_NAME_PREFIX), ident)).alias("name"),
        "description",
        ident.alias("label_id"),
        first_truthy(F.col("type"), F.lit("LABEL")).alias("label_type"),
        F.coalesce("subtype", F.lit("")).alias("label_subtype"),
        F.col("createdAt").alias("created_at"),
        F.col("updatedAt").alias("updated_at"),
        naming.abs_link(link_base, F.col("searchLink")).alias("search_link"),
        F.coalesce("tenant", F.lit(tenant)).alias("tenant"),
    )


def datasource_entities(datasources: DataFrame, tenant: str, refs: DataFrame | None = None) -> DataFrame:
    """Catalog entities of the datasources; with ``refs`` (id, collection_ref) also the collection each goes to."""
    ident = F.col("id").cast("string")
    if refs is not None:
        datasources = datasources.join(refs, "id", "left")
    return datasources.select(
        F.lit(wire.DATASOURCE_TYPE).alias("type_name"),
        naming.datasource_qn(F.lit(tenant), ident).alias("qualified_name"),
        F.coalesce("name", ident).alias("name"),
        ident.alias("datasource_id"),
        F.coalesce("connector_type", F.lit("")).alias("connector_type"),
        F.lit(tenant).alias("tenant"),
        *(["collection_ref"] if refs is not None else []),
    )


def has_edges(pairs: DataFrame, labels: DataFrame, tenant: str, as_of: str | None = None) -> DataFrame:
    """The edge from each datasource to each label found in it, with the number of files and the time of the count."""
    known = labels.select(F.col("id").cast("string").alias("label_id"), F.col("tenant").alias("label_tenant"))
    tag = naming.tag_qn(first_truthy(F.col("label_tenant"), F.lit(tenant)), F.col("label_id"))
    return pairs.join(known, "label_id").select(
        F.lit(wire.HAS_RELATION).alias("relation"),
        naming.datasource_qn(F.lit(tenant), F.col("ds.id")).alias("datasource_qn"),
        tag.alias("label_qn"),
        "document_count",
        F.lit(as_of).cast("string").alias("stats_updated_at"),
    )


def lineage_rows(pairs: DataFrame, labels: DataFrame, datasources: DataFrame, tenant: str, link_base: str) -> DataFrame:
    """One process per datasource and label, with its text, its input and its output.

    A label's own description replaces the standard sentence; lines about what is not known are
    left out. What the process says of a datasource is what its last label saw.
    """
    known = labels.select(
        F.col("id").cast("string").alias("label_id"),
        first_truthy(F.col("name"), F.col("id").cast("string")).alias("label_name"),
        "description",
        first_truthy(F.col("type"), F.lit("LABEL")).alias("label_type"),
        F.nullif("subtype", F.lit("")).alias("label_subtype"),
        F.nullif("createdAt", F.lit("")).alias("created_at"),
        F.nullif("updatedAt", F.lit("")).alias("updated_at"),
        naming.abs_link(link_base, F.col("searchLink")).alias("search_link"),
        first_truthy(F.col("tenant"), F.lit(tenant)).alias("label_tenant"),
    )
    sources = datasources.select(
        F.col("id").alias("ds_id"),
        F.col("name").alias("ds_name"),
        F.nullif("connector_type", F.lit("")).alias("connector_type"),
        "connector_name",
        "connector_id",
    )
    rows = pairs.select("label_id", F.col("ds.id").alias("ds_id")).join(known, "label_id").join(sources, "ds_id")
    sentence = F.format_string(wire.PROCESS_TEXT, "label_name", "ds_name", "ds_id")
    facts = ["label_type", "label_subtype", "created_at", "updated_at", "search_link"]
    lines = [F.concat(F.lit(title), F.col(fact)) for title, fact in zip(wire.PROCESS_LINES, facts)]
    ds_qn = naming.datasource_qn(F.lit(tenant), F.col("ds_id"))
    tag_qn = naming.tag_qn(F.col("label_tenant"), F.col("label_id"))
    return rows.select(
        F.lit(wire.PROCESS_TYPE).alias("type_name"),
        naming.process_qn(F.lit(tenant), F.col("ds_id"), F.col("label_id")).alias("qualified_name"),
        F.format_string(wire.PROCESS_NAME, "ds_name", "label_name").alias("name"),
        F.concat_ws("\n", first_truthy(F.col("description"), sentence), *lines).alias("description"),
        *facts,
        F.col("ds_id").alias("datasource_id"),
        F.col("ds_name").alias("datasource_name"),
        "connector_type",
        "connector_id",
        "connector_name",
        ds_qn.alias("input_qn"),
        tag_qn.alias("output_qn"),
    )


def lookup_by_name(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities by type and qualified name."""
    return entities.join(wanted, ["type_name", "qualified_name"])


def lookup_by_attribute(entities: DataFrame, type_name: str, attribute: str, value: str) -> DataFrame:
    return entities.filter((F.col("type_name") == type_name) & (F.col(attribute) == value))


def stale(existing: DataFrame, incoming: DataFrame, tenant: str) -> DataFrame:
    """Names in the catalog for this tenant that no longer come in."""
    mine = existing.filter(F.col("tenant") == tenant).select("qualified_name")
    return mine.join(incoming.select("qualified_name"), "qualified_name", "left_anti")


def apply_deletes(existing: DataFrame, names: DataFrame) -> DataFrame:
    return existing.join(names.select("qualified_name"), "qualified_name", "left_anti")


def upsert_entities(target: DataFrame, source: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Target with the source merged in; ``change`` says created, updated or kept.

    A source row replaces the attributes it has; attributes only the target knows stay.
    """
    old, new = target.alias("old"), source.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_new, is_old = F.col(f"new.{key}").isNotNull(), F.col(f"old.{key}").isNotNull()
    names = target.columns + [c for c in source.columns if c not in target.columns]

    def merged(name: str) -> Column:
        if name not in source.columns:
            return F.col(f"old.{name}")
        if name not in target.columns:
            return F.col(f"new.{name}")
        return F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    change = F.when(is_new & is_old, "updated").when(is_new, "created").otherwise("kept")
    return joined.select(*[merged(n).alias(n) for n in names], change.alias("change"))


def merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union with the attributes of both; nothing is removed, and a changed type is an error."""
    types = dict(old.dtypes)
    changed = [name for name, kind in new.dtypes if types.get(name, kind) != kind]
    if changed:
        raise ValueError("attributes may not change their type: " + ", ".join(changed))
    return old.unionByName(new, allowMissingColumns=True)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by name: attributes of ``new`` overlay those of ``old``, inputs and outputs are united.

    Both sides: ``qualified_name, attributes`` (map), ``inputs, outputs`` (arrays).
    """
    left = old.select("qualified_name", *[F.col(c).alias(f"old_{c}") for c in ("attributes", "inputs", "outputs")])
    right = new.select("qualified_name", *[F.col(c).alias(f"new_{c}") for c in ("attributes", "inputs", "outputs")])
    joined = left.join(right, "qualified_name", "full_outer")
    fresh = F.coalesce("new_attributes", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(
        F.coalesce("old_attributes", F.create_map().cast("map<string,string>")),
        lambda key, _: ~F.array_contains(F.map_keys(fresh), key),
    )

    def united(name: str) -> Column:
        none = F.array().cast("array<string>")
        return F.array_union(F.coalesce(f"old_{name}", none), F.coalesce(f"new_{name}", none)).alias(name)

    return joined.select(
        "qualified_name", F.map_concat(kept, fresh).alias("attributes"), united("inputs"), united("outputs")
    )
