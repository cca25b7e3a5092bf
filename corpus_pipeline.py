"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. No stage needs unique ids: rows are told
apart by id and text; null ids are rows like others; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import chosen_path, exact_dedup, langid, mixing, packing
from seqloom.llm.queries import BYTE_BPE, MIX_EPOCHS, MIX_SEED, MIX_TREE, MIX_WEIGHTS, SEQUENCE_TOKENS, domain_of
from seqloom.llm.storage import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on all labelled rows; rejected documents go: null, no letter, too far.

    Repeated rows are judged alike. Without a labelled row nothing is learnt
    and every document is rejected.
    """
    model = langid.fit(docs)
    judged = langid.identify(docs, model, names=("__lang", "__score", "__rejected"))
    return judged.where("not __rejected").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one row stays: the longest text, then the least id, null ids last.

    Null and empty texts are one group.
    """
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies the one with the least id stays.

    Texts without words have no copies and stay; a text without a link stays
    whatever other rows have its id.
    """
    return chosen_path.keep_one(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights; a document of two epochs is two rows.

    Documents are whole here: the one in which a leaf's token prefix ends stays
    whole as well. A row's place in the order is a hash of its id and text; rows
    equal in both all get the copies of the first. Null sources and languages
    are leaves of their own. Tokens are those of the tokenizer that packs;
    empty texts have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("(none)")), F.md5(text.cast("binary")))
    tagged = docs.withColumn("__row", row)
    slim = tagged.select("__row", "lang", "source", domain_of().alias("domain"), "text")
    counted = mixing.token_count(slim, BYTE_BPE, out="__n").drop("text")
    chosen = mixing.mix(counted, MIX_TREE, MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED, id_col="__row", tokens_col="__n")
    times = chosen.groupBy(F.col("__row").alias("__key")).agg(F.max("copies").alias("__times"))
    joined = tagged.join(times.hint("shuffle_hash"), F.col("__row") == F.col("__key"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset; null text is the end token only."""
    return packing.pack(packing.token_pieces(docs, BYTE_BPE, SEQUENCE_TOKENS), SEQUENCE_TOKENS)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", target_mix),
    ("best-fit packing", packed_sequences),
]

#: The learned, hashed and tokenised stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
