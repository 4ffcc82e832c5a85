"""Properties that could link the classes of a mapping, from domains and ranges of ontologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.terms import RDFS
from ..sources.mapping import BAG, DATATYPE_PROPERTY, Mapping


def domains_and_ranges(triples: DataFrame) -> DataFrame:
    """Rows (property, domain, range) of an ontology's triples (s, p, o)."""
    domain = triples.where(F.col("p") == RDFS + "domain").select(F.col("s").alias("property"), F.col("o").alias("domain"))
    range_ = triples.where(F.col("p") == RDFS + "range").select(F.col("s").alias("property"), F.col("o").alias("range"))
    return domain.join(range_, "property").distinct()


def suggest_classes(resources: DataFrame, ontologies: list[DataFrame]) -> DataFrame:
    """Rows (domain, range, property, ontology, subjects, objects): the properties that could link resources (uri, class) of
    two classes, and how many resources these have. With the resources' classes that says all that suggest() lists, whose
    rows are all pairs. A property that two ontologies give a pair of classes counts for the first."""
    out = None
    for k, o in enumerate(ontologies):
        part = o.select("property", "domain", "range", F.lit(k).alias("ontology"))
        out = part if out is None else out.unionByName(part)
    links = out.groupBy("property", "domain", "range").agg(F.min("ontology").alias("ontology"))
    sizes = resources.distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    a = sizes.select(F.col("class").alias("domain"), F.col("n").alias("subjects"))
    b = sizes.select(F.col("class").alias("range"), F.col("n").alias("objects"))
    return links.join(a, "domain").join(b, "range").select("domain", "range", "property", "ontology", "subjects", "objects")


def suggest(resources: DataFrame, ontologies: list[DataFrame], subjects: Column | None = None) -> DataFrame:
    """resources: (uri, class). Rows (subject, object, property, ontology) for ordered pairs of different
    resources. subjects: a condition on uri, for the pairs of some only."""
    links = suggest_classes(resources, ontologies).select("domain", "range", "property", "ontology")
    mine = resources if subjects is None else resources.where(subjects)
    a = mine.select(F.col("uri").alias("subject"), F.col("class").alias("domain"))
    b = resources.select(F.col("uri").alias("object"), F.col("class").alias("range"))
    return links.join(a, "domain").join(b, "range").where("subject != object").select("subject", "object", "property", "ontology").distinct()


def typed_resources(spark, mapping: Mapping) -> DataFrame:
    rows = [(u, c) for u in [*mapping.nodes, *mapping.inputs, *mapping.row_entities] for c in mapping.classes(u) if c not in (DATATYPE_PROPERTY, BAG, mapping.term("customResource"))]
    return spark.createDataFrame(sorted(set(rows)), "uri string, class string")


def suggestions(spark, mapping: Mapping, ontologies: list[DataFrame]) -> dict[tuple[str, str], list[str]]:
    """For each ordered pair of the mapping's resources, the properties in the order of the ontologies."""
    df = suggest(typed_resources(spark, mapping), ontologies)
    out: dict[tuple[str, str], list[str]] = {}
    for r in df.orderBy("subject", "object", "ontology", "property").toLocalIterator():
        out.setdefault((r.subject, r.object), []).append(r.property)
    return out
