"""URL filters (operator 1): a blocked Bloom filter in front of an exact hash join.

Canonical form: no scheme, user or fragment; the host in lower case without `www.`, `m.` and default ports; no tracking parameters
(utm_*, ref, fbclid, gclid, sessionid), the others sorted; no slash at the end. It is computed by built-in functions.

The listed canonical URLs are put into a split-block Bloom filter: a 64-bit hash picks a block of eight 64-bit words and one bit in
each. It is built by grouping on the block and or-ing words, so the list is never gathered; only the finished filter is
broadcast. It has `bits_per_url` bits a listed URL, up to `most_blocks` blocks of 64 bytes; a list too long for that shares the
blocks there are, which costs more false positives and no result. Rows that miss the filter are not listed and are not moved.
Possible hits alone, few beside the whole, are shuffled and joined exactly with the list, which removes false positives.

Defined results: a NULL or blank URL is not listed and its canonical form is NULL; repeated URLs, in the table and in the list,
are judged alike and each row stays once; an empty list lists nothing; an empty table gives no rows; all columns are kept (but
`canonical` and `listed`, which are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
#: Blocks of a filter at most: 128 MB, enough for 67 million URLs at 16 bits.
MOST_BLOCKS = 1 << 21
#: Odd and below 2**31, so products with 31 bits of a hash stay within a long.
SALTS = (0x3C6EF373, 0x5851F42D, 0x1B873593, 0x27D4EB2F, 0x6C62272F, 0x7FEB352D, 0x45D9F3B5, 0x4CF5AD43)
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """The canonical form of a URL column."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^(www\.|m\.)+", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.length(F.trim(url)) > 0, F.concat(host, path, tail))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks).cast("long"))


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocks in use, from distinct hashes (h)."""
    low = F.col("h").bitwiseXOR(F.shiftrightunsigned("h", 32)).bitwiseAND(F.lit(0x7FFFFFFF))
    words = [F.expr(f"bit_or(shiftleft(1L, cast((low * {s}L & 4294967295L) >> 26 as int)))").alias(f"w{i}") for i, s in enumerate(SALTS)]
    return keys.select(_block(F.col("h"), blocks).alias("block"), low.alias("low")).groupBy("block").agg(*words)


def may_contain(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes may be in a filter, given as (blocks, 8) words."""
    block = h % len(table)  # of the divisor's sign, as pmod
    u = h.view(np.uint64)
    low = (u ^ (u >> np.uint64(32))) & np.uint64(0x7FFFFFFF)
    out = np.ones(len(h), bool)
    for i, s in enumerate(SALTS):
        bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        out &= (table[block, i] >> bit) & np.uint64(1) == 1
    return out


def filled(keys: DataFrame, n: int, bits: int, most_blocks: int) -> np.ndarray:
    """The filter of n distinct hashes (h), of a size that is bounded whatever n is."""
    blocks = min(max(1, -(-n * bits // 512)), max(1, most_blocks))
    table = np.zeros((blocks, 8), np.uint64)
    words = build_filter(keys, blocks).toArrow()  # at most `blocks` rows
    at = words["block"].to_numpy()
    for i in range(8):
        table[at, i] = words[f"w{i}"].to_numpy().view(np.uint64)
    return table


def filter_urls(pages: DataFrame, listed: DataFrame, *, url_col: str = "url", list_col: str = "url", bits_per_url: int = BITS_PER_URL, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """pages with canonical, and listed: whether the canonical URL is one of those of `listed`."""
    keys = listed.select(canonical(F.col(f"`{list_col}`")).alias("__ink_key")).where("__ink_key is not null").distinct()
    rows = pages.drop("canonical", "listed").withColumn("canonical", canonical(F.col(f"`{url_col}`")))
    sent = pages.sparkSession.sparkContext.broadcast(filled(keys.select(F.xxhash64("__ink_key").alias("h")), keys.count(), bits_per_url, most_blocks))

    @F.arrow_udf("boolean")
    def possible(h: pa.Array) -> pa.Array:
        return pa.array(may_contain(sent.value, h.to_numpy(zero_copy_only=False)))

    marked = rows.withColumn("__ink_possible", F.col("canonical").isNotNull() & possible(F.xxhash64("canonical")))
    # two branches over the source, so that misses stay out of the join's shuffle
    missed = marked.where(~F.col("__ink_possible")).withColumn("listed", F.lit(False))
    hits = marked.where("__ink_possible").join(keys.withColumn("__ink_hit", F.lit(True)), F.col("canonical") == F.col("__ink_key"), "left").withColumn("listed", F.coalesce("__ink_hit", F.lit(False)))
    return missed.drop("__ink_possible").unionByName(hits.drop("__ink_possible", "__ink_key", "__ink_hit"))
