"""The corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``docs``.  The classifiers learn
from the labelled rows among the documents that reach them.
"""

from gridloom.llm import compression, dedup, packing, toxicity
from gridloom.llm.common import Scratch, table


def good_quality(spark, docs, sf_dir):
    """Documents that the compression classifier accepts."""
    return compression.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark, docs, sf_dir):
    """Documents that the fuzzy lexicon does not find toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies (five words, similarity 0.8), that with the smallest doc_id."""
    return dedup.drop_near_duplicates(docs, size=5, percent=80)


def packed(spark, docs, sf_dir):
    """Batches of documents of similar length: doc_id, length, bucket, boundary, batch_id, slot, padding."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", without_near_duplicates), ("packing", packed)]
ORACLE_SQL = None  # classifiers, sketches and the dynamic program are tested against plain versions


def run(spark, sf_dir):
    """All stages over ``documents``; what a stage keeps is written and reread, so its scores are computed once."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
