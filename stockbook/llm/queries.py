"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockbook.llm import (
    arc_warc,
    ball_tree,
    dart_minhash,
    decontaminate,
    iforest,
    language,
    line_runs,
    multi_index,
    pieces,
    radix_windows,
    spelling,
    token_store,
    toxicity,
)
from stockbook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_shipped: set[str] = set()
#: Bytes of an Arrow batch of documents; a longer text is a batch of its own.
ARROW_BYTES = "4m"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; STOCKBOOK_TOKENIZERS names another folder."""
    folder = os.environ.get("STOCKBOOK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, and bound what a
    Python worker holds at once by bytes (10,000 texts may be any number of them)."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="stockbook-ship-"), "stockbook.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "stockbook")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_language_codes(spark, sf_dir):
    """Language of every document."""
    return language.identify_held_out(table(spark, sf_dir, "documents"))


@query
def op2_toxic_segments(spark, sf_dir):
    """Toxicity of every document."""
    return toxicity.score_held_out(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels")).drop("passages")


@query
def op3_arc_to_warc(spark, sf_dir):
    """Pages as ARC, converted to WARC files, read back."""
    return arc_warc.round_trip(arc_warc.arc_of_pages(table(spark, sf_dir, "pages")))


@query
def op4_token_frames(spark, sf_dir):
    """Token files of all documents, read back."""
    return token_store.token_round_trip(table(spark, sf_dir, "documents"),
                                        tokenizer_path("word_bpe_49k.json"))


@query
def op5_dart_minhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_decontaminate(spark, sf_dir):
    """Benchmark windows in all documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark")).drop("spans")


@query
def op7_line_runs(spark, sf_dir):
    """Repeated lines of all documents."""
    return line_runs.dedup_lines(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op8_pieces(spark, sf_dir):
    """Piece ids of all documents, with the check of their decoding."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"),
                                   tokenizer_path("piece_bpe_32k.model"))


@query
def op9_isolation_forest(spark, sf_dir):
    """Rule statistics and verdict of all documents."""
    return iforest.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_radix_windows(spark, sf_dir):
    """Repeated 400-byte windows of all documents."""
    return radix_windows.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_ball_tree(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_multi_index(spark, sf_dir):
    """The ten nearest vectors found of every hundredth one."""
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


@query
def op13_spelling_variants(spark, sf_dir):
    """Near words, forms and roots of all words."""
    return spelling.variants(table(spark, sf_dir, "documents"))
