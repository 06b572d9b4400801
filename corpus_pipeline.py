"""From raw documents to token files, in five stages over whole tables.

Each stage is a function of (spark, docs, sf_dir), `docs` being all that the stage before kept. All but
the last return the columns of documents, of whatever names: columns besides doc_id, text and source pass as they are.
Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.operators.staging import gone_at_exit, shared_dir

from quern.llm.decontaminate import clean
from quern.llm.mixing import mix
from quern.llm.near_dedup import keep_first
from quern.llm.quality import keep_good
from quern.llm.queries import table, tokenizer_path
from quern.llm.stage import Stage
from quern.llm.token_files import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more.

    A null text is scored as an empty one; a null id is scored and never learnt from. Repeated rows are judged each,
    and alike. Without labels of both kinds all scores are 0.5, so nothing is kept.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Texts that are null, empty or without words are like nothing and stay, as do rows with a null id. The least id of a
    group stays with all its rows; of an id with several texts all rows go if it is not the least.
    """
    return keep_first(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts and items match nothing; repeated rows share their fate."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again as the mix asks for.

    A null source is a source of its own, a null text has no tokens. Repeated rows are documents each. Columns named
    `pass`, `block` or `n_tokens` are not among those of documents; here they would be replaced.
    """
    return mix(docs)[0].select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row for each document in them, in ascending order of doc_id, nulls first.

    A null text gives the end id alone; repeated rows are documents each.
    """
    path = gone_at_exit(spark, f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    write_tokens(docs, path, tokenizer_path())
    return read_tokens(spark, path)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), name)
        if i:
            stage.drop(STAGES[i - 1][0])
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
