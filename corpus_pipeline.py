"""From raw documents to sharded training data: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns documents again; its result
is written to the shared folder and read again as the next one's docs. The last stage adds the shard.

Defined results: a null or empty text has no words and goes in the first stage; texts of any length are judged whole; of rows
equal in id and text one stays after near-dedup, and ties among near copies go to the smallest id, null last; a null lang is a
stratum and a null source a source of its own; the mix may take a row up to three times, and its copies share a shard; columns
besides those of documents come along, whatever their names (one called `shard` is kept as `_shard`); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewright.llm import op01_decontamination, op04_simhash, op06_sharding, op08_mixing, op10_quality_rules
from placewright.llm.common import settled, table
from placewright.llm.op01_decontamination import clean
from placewright.llm.op04_simhash import keep_one
from placewright.llm.op06_sharding import assign
from placewright.llm.op08_mixing import mix
from placewright.llm.op10_quality_rules import passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return passing(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough of a benchmark go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return assign(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixing), ("sharding", sharding)]


def _over(sql: str, rows: str) -> str:
    """The SQL of an operator over other rows than documents."""
    return f"({sql.replace('FROM documents', f'FROM {rows}')})"


#: The SQL of each stage's operator over what the stage before kept; ids are unique in documents.
ORACLE_SQL = f"""
WITH passing AS MATERIALIZED (SELECT d.* FROM documents d JOIN {_over(op10_quality_rules.ORACLE, "documents")} v ON d.doc_id = v.doc_id WHERE v.kept),
singled AS MATERIALIZED (SELECT d.* FROM passing d JOIN {_over(op04_simhash.ORACLE, "passing")} v ON d.doc_id = v.doc_id WHERE v.component_id = v.doc_id),
cleaned AS MATERIALIZED (SELECT d.* FROM singled d JOIN {_over(op01_decontamination.ORACLE, "singled")} v ON d.doc_id = v.doc_id WHERE NOT v.contaminated),
taken AS MATERIALIZED (SELECT d.*, unnest(range(v.taken // v.size)) AS copy FROM cleaned d JOIN {_over(op08_mixing.ORACLE, "cleaned")} v ON d.doc_id = v.doc_id WHERE v.size > 0)
SELECT d.* EXCLUDE (copy), v.shard FROM taken d JOIN {_over(op06_sharding.ORACLE, "cleaned")} v ON d.doc_id = v.doc_id
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs, name.replace(" ", "-"))
    return docs
