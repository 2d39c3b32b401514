"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes the documents that its predecessor has kept, as a table that was
written and read again, and returns the columns of documents (the last one: ids).

1. language ID drops documents without letters and those in which no language has
   LEAST_SCORE of the letters, and puts the language found where none is given;
2. exact dedup keeps the row with the largest id of equal texts;
3. the n-gram Jaccard join keeps one document (the smallest id) of each class of
   documents at a similarity of 0.8 or more;
4. mixing repeats the documents of small sources, up to MOST_REPEATS times, and puts all in
   mixed order; none is left out;
5. byte-level BPE encodes what is left, one row for each repetition, and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from millrace.workspace import prepare, stored, table

LEAST_SCORE = 0.3
MOST_REPEATS = 2.0
SIMILARITY = 0.8
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all of docs that have a language; keeps the rows with a language, in which `lang`
    is the language found where it was null. Null ids, null texts and repeated rows: see language_id.identify."""
    prepare(spark)
    model = language_id.fit(docs)
    kept = language_id.labelled(docs, model).where((F.col("_lang") != language_id.UNDETERMINED) & (F.col("_score") >= LEAST_SCORE))
    lang = F.coalesce(F.col("_doc").getField("lang"), F.col("_lang"))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col("_doc").getField(c).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts, the one with the largest id."""
    prepare(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents."""
    prepare(spark)
    return ngram_join.one_of_each(docs, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's weight asks for, once at least, in mixed order."""
    prepare(spark)
    return mixing.mixed(docs, MOST_REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (array), decoded_sha256 for each row."""
    import public_tokenizers

    prepare(spark)
    return byte_bpe.token_arrays(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, keep=("lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Language identification and the tokenizer are not expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
