"""A training corpus from raw documents, in five stages.

Each stage works on what the one before has kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import oracles
from threadloom.llm.common import read, shared_table
from threadloom.llm.decontaminate import decontaminated
from threadloom.llm.line_dedup import line_dedup
from threadloom.llm.mixing import mix_sources
from threadloom.llm.near_dedup import near_dedup
from threadloom.llm.quality_rules import quality_rules


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(*[f"`{c}`" for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has."""
    return line_dedup(docs).select(*[f"`{c}`" for c in docs.columns])


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    gone = near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the number of copies it takes."""
    return mix_sources(docs).where("copies > 0").select(*[f"`{c}`" for c in docs.columns], "copies")


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("near dedup", copies),
    ("decontamination", benchmark),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = f"""WITH RECURSIVE
{oracles.quality_rules("documents")},
p_rules AS (SELECT d.* FROM documents d JOIN q_out q USING (doc_id) WHERE q.kept),
{oracles.line_dedup("p_rules")},
p_lines AS (SELECT d.doc_id, l.text, d.lang, d.source, d.n_chars FROM p_rules d JOIN l_out l USING (doc_id)),
{oracles.near_dedup("p_lines")},
p_copies AS (SELECT d.* FROM p_lines d JOIN n_out n USING (doc_id) WHERE n.kept),
{oracles.overlaps("p_copies")},
p_benchmark AS (SELECT * FROM p_copies WHERE doc_id NOT IN (SELECT doc_id FROM b_out)),
{oracles.mixing("p_benchmark")}
SELECT d.*, m.copies FROM p_benchmark d JOIN m_out m USING (doc_id) WHERE m.copies > 0"""
