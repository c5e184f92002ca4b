"""Model lineage: layer nodes and edges per dataset, relationships between models of a spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.operators.unnest import unnest

# The layers every dataset passes through, in order.
LAYERS = (
    ("raw_input", "Raw Input"),
    ("warehouse_raw", "Warehouse Raw"),
    ("staging", "Staging"),
    ("intermediate", "Intermediate"),
    ("dimensional_model", "Dimensional Model"),
    ("data_mart", "Data Marts"),
)
# Words too common in model names to link two models.
STOP_WORDS = ("dim", "fact", "mart", "data", "performance", "summary", "analysis", "analytics", "total")


def layer_nodes(datasets: DataFrame) -> DataFrame:
    """Six nodes per dataset. The first two hold data from the start; the rest follow the dataset."""
    waiting = F.when(F.col("status") == "ready_for_analysis", "completed").when(
        F.col("status") == "transforming", "waiting"
    ).otherwise("not_started")
    nodes = F.array(
        *(
            F.struct(
                F.lit(at).alias("position"), F.lit(kind).alias("node_type"), F.lit(label).alias("label"),
                (F.lit("completed") if at < 2 else waiting).alias("node_status"),
            )
            for at, (kind, label) in enumerate(LAYERS)
        )
    )
    return datasets.select("dataset_id", F.inline(nodes))


def layer_edges(datasets: DataFrame) -> DataFrame:
    """Each layer prepares the next one."""
    pairs = F.array(
        *(
            F.struct(F.lit(a).alias("from_node"), F.lit(b).alias("to_node"))
            for (a, _), (b, _) in zip(LAYERS, LAYERS[1:])
        )
    )
    return datasets.select("dataset_id", F.inline(pairs)).withColumn("edge_type", F.lit("prepares"))


def _marts(specs: DataFrame) -> DataFrame:
    return unnest(specs, ["proposal_id", "dimensions"], "marts", "m")


def relationships(specs: DataFrame) -> DataFrame:
    """Fact-to-dimension links by key and mart-to-dimension links by shared fields, one row each."""
    fact = unnest(specs, ["proposal_id", "fact_name"], "dimensions", "d").select(
        "proposal_id", F.col("fact_name").alias("from_model"), F.col("d.name").alias("to_model"),
        F.lit("fact_to_dimension").alias("relationship_type"), F.array("d.key_column").alias("join_fields"),
    )
    shared = F.filter("m.dimensions", lambda f: F.array_contains(F.col("d.columns"), f))
    marts = (
        unnest(_marts(specs), ["proposal_id", "m"], "dimensions", "d")
        .select(
            "proposal_id", F.col("m.name").alias("from_model"), F.col("d.name").alias("to_model"),
            F.lit("mart_to_dimension").alias("relationship_type"), shared.alias("join_fields"),
        )
        .filter(F.size("join_fields") > 0)
    )
    return fact.unionByName(marts)


def related_dimensions(specs: DataFrame) -> DataFrame:
    """Per mart, the dimensions that hold at least one of its fields, in spec order."""
    mart = _marts(specs)
    hits = F.filter("dimensions", lambda d: F.arrays_overlap(d["columns"], F.col("m.dimensions")))
    return mart.select(
        "proposal_id", F.col("m.name").alias("mart"),
        F.transform(hits, lambda d: d["name"]).alias("related_dimensions"),
    )


def column_owners(specs: DataFrame) -> DataFrame:
    """The first dimension, in spec order, that lists each column."""
    each = unnest(specs, ["proposal_id"], "dimensions", "d", "position")
    listed = each.select(
        "proposal_id", "position", F.col("d.name").alias("dimension"), F.explode("d.columns").alias("column")
    )
    return listed.groupBy("proposal_id", "column").agg(F.min_by("dimension", "position").alias("owner"))


def name_tokens(text):
    """Lower-case word parts of a joined name list, without one-letter parts and stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "_")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def matching_dimensions(specs: DataFrame) -> DataFrame:
    """Dimensions shown next to each mart: those sharing a field, else those sharing a name token."""
    mart = _marts(specs)
    fields = F.transform("m.dimensions", F.lower)
    explicit = F.filter(
        "dimensions",
        lambda d: F.arrays_overlap(
            F.transform(F.concat(F.array(d["key_column"]), d["columns"], F.array(d["name"])), F.lower), fields
        ),
    )
    wanted = name_tokens(F.concat_ws("_", F.array("m.name"), "m.dimensions"))
    by_token = F.filter(
        "dimensions",
        lambda d: F.arrays_overlap(
            name_tokens(F.concat_ws("_", F.array(d["name"], d["key_column"]), d["columns"])), wanted
        ),
    )
    chosen = F.when(F.size(explicit) > 0, explicit).otherwise(by_token)
    return mart.select(
        "proposal_id", F.col("m.name").alias("mart"),
        F.when(F.size(explicit) > 0, "field").when(F.size(by_token) > 0, "token").otherwise("none").alias("match"),
        F.transform(chosen, lambda d: d["name"]).alias("dimensions"),
    )
