"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

Language identification drops documents without a known language, near-dedup
keeps one document of each group of copies, the secret scan masks what it
finds, mixing brings sources to target weights (a document that the mix takes
twice appears twice), and BPE encoding gives the token ids.

Defined cases: a null, empty or letterless text goes in the first stage; a null
id is kept unless a copy has an id; of rows that agree in id and text one stays;
where no row has a label, every text with a letter counts as identified; a null
source is a source of its own; extra columns are carried up to the last stage;
an empty table gives an empty result. Each stage's tables stay in
``spark.checkpoint.dir`` for its owner to clear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, language, mixing, near_dedup, secrets
from driftline.llm.common import materialize, table
from driftline.llm.queries import CODE_VOCABULARY, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, keep_text=True)
    text = secrets.redact(F.col("row.text"), F.col("all"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.size("all") > 0, F.length(text).cast(kind)).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary(CODE_VOCABULARY), with_ids=True).drop("decoded")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language, near-dedup and BPE have no SQL form; tests hold the run against a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
