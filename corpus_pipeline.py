"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of their input.

Defined results: null and empty texts are scored, are each other's copies, and pack as the end id
alone; very long texts are read whole and packed in pieces; without labels of both kinds every document is kept;
of equal rows one stays; ties in near-dedup go to the least id; an empty table gives no rows; other
columns pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histsearch.llm.common import materialize, read_table
from histsearch.llm.lines import drop_repeated_lines
from histsearch.llm.mixing import mix_sources
from histsearch.llm.packing import pack
from histsearch.llm.quality import keep_good
from histsearch.llm.shingles import drop_similar


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; links are texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, found by covering SimHash and, beyond its
    radius, exactly (op5's own contract differs)."""
    return drop_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences go; n_chars follows the text."""
    cleaned = drop_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    names = docs.columns
    marked = [f"_c{i}" for i in range(len(names))]
    mixed = mix_sources(docs, columns=names, aliases=marked)
    copied = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*[F.col(m).alias(n) for m, n in zip(marked, names)])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_to_weights", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: The stages hash, learn and tokenise in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written once and read by the next, so that no
    stage runs again for the jobs of those after it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
