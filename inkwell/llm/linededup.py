"""Line dedup (operator 10): levelled sorted runs of line hashes.

The store keeps runs: tables of 128-bit line hashes, bucketed and sorted by the hash. A batch of documents is reduced to the first
occurrence of each of its lines, merge-anti-joined with every run (equal buckets, so the runs are never shuffled again), and
what is new becomes a run of level 0. `fanout` runs of one level are compacted into one run of the next, so the number of runs
grows with the logarithm of the batches. A store lives in a folder that all executors share, with a list of its runs that is
replaced by a rename once a batch is in; `LineRuns.open` takes it up again in any session, so later batches meet earlier ones
(`dedup_batch`). A batch that failed leaves only files that no list names.

A line is what stands between line feeds, without the spaces around it; empty ones are never removed, and neither are lines of
fewer than `min_chars` characters where that is set above 1. Of equal lines the first stays: the least document id, then the
least line number (NULL ids come first). A document that loses lines and keeps no word goes; one that loses none stays as it is.

Defined results: NULL and empty texts have no lines to lose; a repeated line within one text is a repetition like any other;
rows that share an id are one document with the lines of all, of which equal lines at one place count once (so equal rows all
stay alike); an empty table gives an empty table. All columns are kept, whatever their names. A text's lines are removed in one
pass, so a document of many lines takes time in proportion to them.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, cut, delete
from inkwell.session import read_text, write_text

MIN_CHARS = 1
BATCHES = 6
FANOUT = 3
RUN = "h1 LONG, h2 LONG, doc_id LONG, no INT"


def _trim(line: Column) -> Column:
    return F.trim(line)


class LineRuns:
    """The runs of one store, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, at: str, *, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.at, self.fanout = spark, at.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    @classmethod
    def open(cls, spark: SparkSession, at: str, *, buckets: int | None = None, fanout: int = FANOUT) -> LineRuns:
        """The store in this folder as it was left, or a new one; the number of buckets is that of its first batch."""
        out = cls(spark, at, buckets=buckets, fanout=fanout)
        if (text := read_text(spark, f"{out.at}/runs.json")) is not None:
            d = json.loads(text)
            out.buckets, out.levels = d["buckets"], d["levels"]
            for name in out._names():
                out._register(name)
        return out

    def _names(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _register(self, name: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.at}/{name}'")

    def _commit(self, gone: list[str]) -> None:
        """The list of runs as it is now; then what it no longer names goes."""
        write_text(self.spark, f"{self.at}/runs.json", json.dumps({"buckets": self.buckets, "levels": self.levels}))
        for r in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            delete(self.spark, f"{self.at}/{r}")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.select("h1", "h2", "doc_id", F.col("no").cast("int").alias("no")).repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.at}/{name}").saveAsTable(name))
        return name

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of lines (h1, h2, ...) that no run has: one merge anti join a run."""
        for name in self._names():
            lines = lines.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, firsts: DataFrame) -> str:
        """Adds the lines (h1, h2, doc_id, no; each hash once) that no run has; the name of the run that has them."""
        name = self._write(self.unseen(firsts))
        gone: list[str] = []
        self._keep(name, 0, gone)
        self._commit(gone)
        return name

    def _keep(self, name: str, level: int, gone: list[str]) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._union(runs))
            gone += runs
            self._keep(merged, level + 1, gone)

    def _union(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], RUN)
        out = self.spark.table(runs[0])
        for r in runs[1:]:
            out = out.unionByName(self.spark.table(r))
        return out

    def all(self) -> DataFrame:
        """Every line's first occurrence."""
        return self._union(self._names())

    def close(self) -> None:
        """Forgets the tables in this session's catalog; the store's files stay."""
        for r in self._names():
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("no", "line"))
    line = lines.withColumn("line", _trim(F.col("line"))).where(F.length("line") >= max(1, min_chars))
    return line.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "doc_id", "no")


def _firsts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "no")).alias("f")).select("h1", "h2", "f.doc_id", "f.no")


def _gone(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, no, h1) of the lines that are not the first of their kind."""
    first = first.select("h1", "h2", F.col("doc_id").alias("fd"), F.col("no").alias("fn"))
    gone = lines.join(first.hint("merge"), ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("no") == F.col("fn"))))
    return gone.select("doc_id", "no", "h1").distinct()


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, no, h1) of every line that goes."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        found = _occurrences(docs, id_col, text_col, min_chars)
        span = docs.select(F.min(F.col(f"`{id_col}`").cast("long")), F.max(F.col(f"`{id_col}`").cast("long"))).first()
        low, high = (span[0] or 0), (span[1] or 0)
        step = max(1, -(-(high - low + 1) // batches))
        lines = scratch.table(found.withColumn("batch", F.coalesce(F.floor((F.col("doc_id") - low) / step), F.lit(0)).cast("int")), "batch")
        runs = LineRuns(spark, scratch.path(), fanout=fanout)
        try:
            for b in range(batches):
                runs.add(_firsts(lines.where(F.col("batch") == b)))
            return cut(_gone(lines, runs.all()))
        finally:
            runs.close()


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, count_as: str | None) -> DataFrame:
    """docs without the lines (doc_id, no, h1); texts that lose lines are rebuilt in Arrow batches, the others do not leave the JVM."""
    per = gone.groupBy(F.col("doc_id").alias("__ink_id")).agg(F.sort_array(F.collect_set(F.struct("no", "h1"))).alias("__ink_gone"))
    text = F.col(f"`{text_col}`")

    @F.arrow_udf("struct<left:string,less:long>")
    def rebuilt(texts: pa.Array, nos: pa.Array, hashes: pa.Array) -> pa.Array:
        import xxhash

        left, less = [], []
        for t, ns, hs in zip(texts.to_pylist(), nos.to_pylist(), hashes.to_pylist()):
            if t is None or ns is None:
                left.append(None)
                less.append(0)
                continue
            lines = t.split("\n")
            n = len(lines)
            for no, h in zip(ns, hs):
                # of rows that share an id, only those lose a line that have it there; the hash is that of the expression xxhash64
                if no < n and lines[no] is not None and xxhash.xxh64_intdigest(lines[no].strip(" ").encode(), 42) == h & 0xFFFFFFFFFFFFFFFF:
                    lines[no] = None
            kept = [x for x in lines if x is not None]
            left.append("\n".join(kept))
            less.append(n - len(kept))
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(less, pa.int64())], ["left", "less"])

    joined = docs.join(per.hint("shuffle_hash"), docs[f"`{id_col}`"].cast("long").eqNullSafe(per["__ink_id"]), "left")
    has = F.col("__ink_gone").isNotNull()
    done = joined.withColumn("__ink_new", rebuilt(F.when(has, text.cast("string")), F.col("__ink_gone.no"), F.col("__ink_gone.h1")))
    less = F.coalesce(F.col("__ink_new.less"), F.lit(0))
    done = done.where((less == 0) | F.col("__ink_new.left").rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]"))
    extra = [less.cast("long").alias(count_as)] if count_as else []
    return done.select(*[F.when(less > 0, F.col("__ink_new.left")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *extra)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, count_as: str | None = None) -> DataFrame:
    """docs without repeated lines; with `count_as`, a column of that name counts the lines removed from each."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, batches=batches, fanout=fanout)
    return _without(docs, gone, id_col, text_col, count_as)


def dedup_batch(docs: DataFrame, runs: LineRuns, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, count_as: str | None = None) -> DataFrame:
    """docs without the lines that an earlier batch of the store, or an earlier place of this one, has; this batch's lines are added.

    Earlier batches keep what they have, whatever the ids, so a batch is added once: after a failure it is simply given again.
    """
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.table(_occurrences(docs, id_col, text_col, min_chars))
        firsts = scratch.table(runs.unseen(_firsts(lines)))
        keep = firsts.select("h1", "h2", F.col("doc_id").alias("fd"), F.col("no").alias("fn"))
        rest = lines.join(keep, ["h1", "h2"], "left").where(F.col("fn").isNull() | ~(F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("no") == F.col("fn"))))
        gone = cut(rest.select("doc_id", "no", "h1").distinct())
        runs.add(firsts)
    return _without(docs, gone, id_col, text_col, count_as)
