"""Documents to training shards: judged, deduplicated, decontaminated, mixed, sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's docs. All stages but the last
keep the columns of documents, and also columns of other names that the table has,
whatever they are called; the last adds hilbert, shard and slot (columns of these
names are replaced).

Defined cases: NULL texts count as empty for the classifier, have no shingles, no
benchmark words and size 0, so they stay only if the classifier keeps them and their
source's rate has whole copies or a draw falls on them; NULL ids stay unless
rejected; NULL sources are a source, NULL languages and lengths fill the lowest
cells. Texts are worked through whole, whatever their length. Of rows that repeat an
id and its text one stays. Without labels of two grades nothing is rejected, without
a benchmark nothing is cut, and no documents give no rows.
"""

from __future__ import annotations

from tabloom.llm import decontam, minhash, mixing, quality, sharding
from tabloom.sources.files import materialise, table


def judged(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.select_documents(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark, docs, sf_dir):
    """Of each group of near-duplicates (five words, similarity 0.8) one document stays."""
    return minhash.deduplicate(docs)


def decontaminated(spark, docs, sf_dir):
    """Passages of the benchmark go, and documents that are benchmark for the most part."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Sources are thinned or repeated to their target weights."""
    return mixing.mix_sources(docs)


def sharded(spark, docs, sf_dir):
    """Documents get their shard and slot along the Hilbert curve."""
    return sharding.hilbert_shards(docs, 24, ties=("n_chars", "text"))


STAGES = [
    ("quality classifier", judged),
    ("near-duplicates", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows that the last stage returns."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
