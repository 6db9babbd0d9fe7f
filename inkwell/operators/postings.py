"""Inverted index tables from documents: tokens, postings, dictionary and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.analysis import Analyzer, terms


def with_token_count(docs: DataFrame, text_col: str = "text", analyzer: Analyzer = terms) -> DataFrame:
    """docs with token_count from the text."""
    return docs.withColumn("token_count", F.size(analyzer(F.col(text_col))))


def _exploded(own: DataFrame, terms_of: Column) -> DataFrame:
    """Rows (doc_id, doc_len, position, term) of rows with _terms, by an outer generator: for others Spark infers a filter on the array, which makes it twice."""
    return own.select("doc_id", F.size("_terms").alias("doc_len"), F.posexplode_outer(terms_of).alias("position", "term"))


def tokens(content: DataFrame, analyzer: Analyzer = terms) -> DataFrame:
    """(doc_id, doc_len, position, term) of every token of (doc_id, text)."""
    own = content.select("doc_id", analyzer(F.col("text")).alias("_terms"))
    return _exploded(own, F.col("_terms")).where("term IS NOT NULL")


def _grouped(token_rows: DataFrame) -> DataFrame:
    return token_rows.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.max("doc_len").alias("doc_len"), F.sort_array(F.collect_list("position")).alias("positions"))


def postings(content: DataFrame, analyzer: Analyzer = terms) -> DataFrame:
    """(term, doc_id, tf, doc_len, positions), positions ascending: grouped within each document's row, without a shuffle.

    Ids are looked through first: if any comes twice, its rows count as one document, and one shuffle groups all tokens by term and document.
    """
    if not content.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _grouped(tokens(content, analyzer))
    own = content.select("doc_id", analyzer(F.col("text")).alias("_terms"))
    return from_forward(own.select("doc_id", F.size("_terms").alias("token_count"), forward(F.col("_terms")).alias("terms")))


def seen(content: DataFrame, wanted: Column, analyzer: Analyzer = terms) -> DataFrame:
    """Postings of the wanted terms, and rows of the term NULL with each document's number of rows as tf and its tokens as total; every text is read once.

    The shuffle has the wanted tokens and one row a document.
    """
    own = content.select("doc_id", analyzer(F.col("text")).alias("_terms"))
    rows = _exploded(own, F.concat(F.array(F.lit(None).cast("string")), "_terms")).where(F.col("term").isNull() | wanted)
    positions = F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.col("position") - 1)))
    return rows.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.max("doc_len").alias("doc_len"), positions.alias("positions"), F.sum(F.when(F.col("term").isNull(), F.col("doc_len"))).alias("total"))


#: A document's distinct terms, each with its frequency and its positions.
FORWARD = "array<struct<term:string,tf:int,positions:array<int>>>"


#: Tokens that one vectorised step groups; one longer text is a step of its own.
STEP_TOKENS = 256 << 10


def group_terms(lists: pa.ListArray) -> pa.ListArray:
    """FORWARD rows of lists of terms, in steps, so that memory beyond the batch does not grow with it; a NULL list counts as empty."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(lists) or not out:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_TOKENS, "right")))
        out.append(_group_step(lists.slice(at, to - at)))
        at = to
    return out[0] if len(out) == 1 else pa.concat_arrays(out)


def _group_step(lists: pa.ListArray) -> pa.ListArray:
    """One sort of the tokens by text and term."""
    many = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(code)) - np.repeat(np.cumsum(many) - many, many)
    key = text * max(len(coded.dictionary), 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(first, len(key))
    positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32)))
    own = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code[order][first])), pa.array(np.diff(ends).astype(np.int32)), positions], ["term", "tf", "positions"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order][first], np.arange(len(many) + 1)).astype(np.int32)), own)


def forward(terms_of: Column) -> Column:
    """The distinct terms of an array of terms, in Arrow batches: a document is whole in its row, so no shuffle groups it."""

    @F.arrow_udf(FORWARD)
    def run(col: pa.Array) -> pa.Array:
        return group_terms(col)

    return run(terms_of)


def from_forward(rows: DataFrame) -> DataFrame:
    """Postings of rows (doc_id, token_count, terms), without a shuffle; by an outer generator, as in `tokens`."""
    return rows.select("doc_id", F.col("token_count").alias("doc_len"), F.explode_outer("terms").alias("_t")).where("_t IS NOT NULL").select("_t.term", "doc_id", "_t.tf", "doc_len", "_t.positions")


def dictionary(posting_rows: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("tf").cast("long")).alias("cf"))


def stats(docs: DataFrame) -> DataFrame:
    """One row: n (1 at least) and avgdl (1.0 at least), as queries use them."""
    return docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("token_count"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def prefix_terms(terms_table: DataFrame, prefix: str) -> DataFrame:
    """Dictionary rows whose term begins with the prefix, in term order."""
    return terms_table.where(F.col("term").startswith(prefix)).orderBy("term")


def term_positions(posting_rows: DataFrame, term: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, positions) of a term, of one document if given; none where it does not occur."""
    own = posting_rows.where(F.col("term") == term)
    return (own if doc_id is None else own.where(F.col("doc_id") == doc_id)).select("doc_id", "positions")


def check_postings(posting_rows: DataFrame) -> DataFrame:
    """Rows that break an invariant: a negative id, a frequency other than the number of positions, positions that do not rise, a pair of term and document that comes twice."""
    p = F.col("positions")
    rising = F.size(F.array_distinct(p)) == F.size(p)
    bad = (F.col("doc_id") < 0) | (F.size(p) != F.col("tf")) | ~rising | (F.sort_array(p) != p)
    twice = posting_rows.groupBy("term", "doc_id").count().where("count > 1").select("term", "doc_id")
    return posting_rows.where(bad).select("term", "doc_id").unionByName(twice).distinct()


@dataclass
class IndexTables:
    """What a search reads. docs: (doc_id, path, extension, size_bytes, mtime, doc_type, token_count); content: (doc_id, text).

    Without a dictionary, frequencies are counted from the postings; without totals (documents, tokens), from docs. With an analyzer the
    tables are unwritten, and a search takes postings, frequencies and totals from one pass over the content.
    """

    docs: DataFrame
    content: DataFrame
    posting_rows: DataFrame | None = None
    dictionary: DataFrame | None = None
    totals: tuple[int, int] | None = None
    analyzer: Analyzer | None = None
    #: What searches have read of unwritten tables, by their words.
    kept: dict[tuple, DataFrame] = field(default_factory=dict)

    @property
    def postings(self) -> DataFrame:
        if self.posting_rows is None:
            self.posting_rows = postings(self.content, self.analyzer or terms)
        return self.posting_rows

    @classmethod
    def of(cls, files: DataFrame, analyzer: Analyzer = terms) -> IndexTables:
        """Unwritten tables of documents with their text: nothing is computed until a query reads it."""
        content = files.select("doc_id", "text")
        docs = with_token_count(files, analyzer=analyzer).drop("text") if "token_count" not in files.columns else files.drop("text")
        return cls(docs, content, analyzer=analyzer)
