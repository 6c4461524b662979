"""A pipeline over documents: quality rules, near-duplicates, personal data, mixing and token ids.

Each stage takes what its predecessor kept, and its decisions take effect: rejected documents and all but one of each
near-duplicate group go, personal data is replaced in the texts, the mix repeats or leaves out documents by its
budgets (the one at a cut is shortened), and the last stage turns the texts into ids. Near-duplicates are texts whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such links connect.

Defined results: a null or empty text fails the quality rules; a null doc_id takes part in all stages and is kept of its
group only where there is no other; a null language is judged by its script, a null source is a source of its own;
texts of any length are read whole; of equal texts and repeated rows the one with the least doc_id stays, and of rows
with the same least doc_id one; further columns come along unchanged, whatever their names, up to the last stage, which gives doc_id and
the ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, pii, quality, shingles, spm
from tessera.runtime import release, stage, staged_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Staged tables behind the result of the last stage that ran.
_BEHIND: list[str] = []


def _alone(function: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage that first deletes what stood behind its predecessor's result, which is written when this one starts.

    Should docs still be read from such a table (an unwritten result was passed on), the table stays.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        kept = release(spark, _BEHIND, docs)
        before = set(staged_paths())
        out = function(docs)
        _BEHIND[:] = kept + [p for p in staged_paths() if p not in before]
        return out

    return run_stage


STAGES = [
    ("quality_rules", _alone(quality.keep_sound)),
    ("near_duplicates", _alone(shingles.one_of_each)),
    ("personal_data", _alone(pii.redact_documents)),
    ("mix_sources", _alone(mixing.mixed_documents)),
    ("token_ids", _alone(partial(spm.encode_documents, with_ids=True))),
]

#: SQL can't express the stages: tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
