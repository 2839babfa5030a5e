"""The whole analysis of evidence blocks, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.tables import settled
from factloom.operators import extract, groups, identity, segments


@dataclass
class Analysis:
    candidates: DataFrame
    groups: DataFrame
    relations: DataFrame
    products: DataFrame


def analyse(blocks: DataFrame) -> Analysis:
    """Blocks (block_id, source_file, file_hash, position, text, atomic, recognition_confidence) to facts.

    Drafts never certify claims: their files are left out.  Versions and the
    historical mark of a document reach the candidates by a join on the file.
    Candidates are written twice on the way, before and after they get owners.
    """
    context = segments.document_context(blocks)
    evidence = context.filter("role = 'evidence'").select("source_file", "version", "historical")
    read = settled(extract.candidates(blocks).join(evidence, "source_file"), "candidates")
    found = identity.resolve_products(read)
    found = found.withColumn("binding", F.when((F.col("rule") == "value_first") & F.col("field").startswith("custom_"), "inferred_value_first").otherwise("explicit"))
    found = settled(found, "owned-candidates")
    relations = groups.cross_field_relations(found)
    return Analysis(found, groups.fact_groups(found, relations), relations, identity.product_entities(found))
