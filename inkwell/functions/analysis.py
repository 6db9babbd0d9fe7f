"""Tokenizers as Column expressions: ASCII words, bigrams of East Asian runs, and both in one position space.

NULL and empty texts give an empty array. All stay on the JVM, but for `tokens`, which adds UTF-16 offsets in an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.constants import STOP_WORDS

#: A tokenizer that the engine accepts: text column to array of terms in position order.
Analyzer = Callable[[Column], Column]

_CJK = r"[[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]&&[\x{0}-\x{FFFF}]]+"
# Plain ranges around those scripts: far quicker to look for than the scripts themselves
_MAY_BE_CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{FFFF}]"
# A token at a place of a lower-cased text, looked ahead at, as pairs overlap; a word is then passed whole, a pair by one character
_ONE_CJK = rf"[{_MAY_BE_CJK}&&{_CJK}]"
_MIXED = f"(?=([a-z0-9]{{2,}}|{_ONE_CJK}{{2}}|(?<!{_ONE_CJK}){_ONE_CJK}))(?:[a-z0-9]+|.)"


def _fast(text: Column, stop_words: bool) -> Column:
    """Words in one regular expression over the lower-cased text, with no function per token.

    Runs of one character are left out by the pattern. The two characters whose lower case has an ASCII letter are blanked before.
    """
    words = F.regexp_extract_all(F.lower(F.translate(text, "\u212a\u0130", "  ")), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS))) if stop_words else words


def _bigrams(run: Column) -> Column:
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def english_terms(text: Column, stop_words: bool = False) -> Column:
    """Runs of ASCII letters and digits, lower case, of two characters at least."""
    return F.coalesce(_fast(text, stop_words), F.array().cast("array<string>"))


def bigram_terms(text: Column) -> Column:
    """Overlapping pairs of every Han, kana or Hangul run; a run of one character stays alone."""
    return F.coalesce(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_CJK), F.lit(0)), _bigrams)), F.array().cast("array<string>"))


def terms(text: Column, stop_words: bool = False) -> Column:
    """Both tokenizers over one text, in text order."""
    mixed = F.regexp_extract_all(F.lower(F.translate(text, "\u212a\u0130", "  ")), F.lit(_MIXED), F.lit(1))
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_MAY_BE_CJK)
    if stop_words:
        mixed = F.filter(mixed, lambda w: ~w.isin(*sorted(STOP_WORDS)))
    return F.coalesce(F.when(plain, _fast(text, stop_words)).otherwise(mixed), F.array().cast("array<string>"))


class Token(NamedTuple):
    term: str
    pos: int
    start: int
    end: int


# The scripts' blocks below U+10000, for Python's regular expressions, which know no scripts
_PY_CJK = "ᄀ-ᇿ⺀-⺙⺛-⻳⼀-⿕々〇〡-〩〮-〯〸-〻ぁ-ゖゝ-ゟァ-ヺヽ-ヿㄱ-ㆎㇰ-ㇿ㈀-㈞㉠-㉾㋐-㋾㌀-㍗㐀-䶿一-鿿ꥠ-ꥼ가-힣ힰ-ퟻ豈-龎ｦ-ｯｱ-ﾝﾠ-ￜ"
_PY = re.compile(f"[A-Za-z0-9]+|[{_PY_CJK}]+")


def analyze(text: str | None, stop_words: bool = False) -> list[Token]:
    """The tokens of one text with UTF-16 offsets; used for queries."""
    out: list[Token] = []
    text = text or ""
    wide = [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", text)]
    k = 0
    for m in _PY.finditer(text):
        while k < len(wide) and wide[k] < m.start():
            k += 1
        run, at = m.group(), m.start() + k
        if run[0] < "\x80":
            if len(run) > 1 and not (stop_words and run.lower() in STOP_WORDS):
                out.append(Token(run.lower(), len(out), at, at + len(run)))
        else:
            for i in range(max(1, len(run) - 1)):
                part = run[i : i + 2]
                out.append(Token(part, len(out), at + i, at + i + len(part)))
    return out


_TOKENS = "array<struct<term:string,pos:int,start:int,end:int>>"
#: UTF-8 bytes of text that one vectorised step works on; one longer text is a step of its own.
STEP_BYTES = 384 << 10
# By code point: 1 in ASCII words, 2 in East Asian runs, 0 in neither
_CLASS = np.zeros(0x10000, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[[m.start() for m in re.finditer(f"[{_PY_CJK}]", "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x10000))))]] = 2


def _numbered(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _analyze_step(texts: list[str], stop_words: bool) -> pa.ListArray:
    """The tokens of `analyze` for many texts at once, over their code points one after another, each text ended by a line break."""
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    kind = np.where(code < 0x10000, _CLASS[code & 0xFFFF], 0)
    first = np.flatnonzero(np.diff(kind, prepend=0))
    long = np.diff(first, append=len(code))
    of = kind[first]
    kept = (of == 2) | (of == 1) & (long > 1)
    first, long, of = first[kept], long[kept], of[kept]
    many = np.where(of == 2, np.maximum(long - 1, 1), 1)
    at = np.repeat(first, many) + _numbered(many)
    size = np.repeat(np.where(of == 2, np.minimum(long, 2), long), many)
    own = code[np.repeat(at, size) + _numbered(size)]
    own = own + 32 * ((own >= 65) & (own <= 90)).astype(np.uint32)
    width = np.concatenate([[0], np.cumsum(1 + (own >= 0x80) + (own >= 0x800))])
    term = pa.StringArray.from_buffers(len(at), pa.py_buffer(width[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)), pa.py_buffer(own.tobytes().decode("utf-32-le").encode()))
    text = np.searchsorted(ends, at, "right")
    if stop_words:
        stays = ~pc.is_in(term, pa.array(sorted(STOP_WORDS))).to_numpy(zero_copy_only=False)
        term, at, size, text = term.filter(pa.array(stays)), at[stays], size[stays], text[stays]
    unit = np.concatenate([[0], np.cumsum(1 + (code >= 0x10000))])
    start = unit[at] - unit[np.concatenate([[0], ends])][text]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    columns = [np.arange(len(at)) - bounds[text], start, start + size]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([term, *(pa.array(c.astype(np.int32)) for c in columns)], ["term", "pos", "start", "end"]))


def _steps(texts: pa.Array, stop_words: bool) -> Iterator[tuple[int, pa.ListArray]]:
    """The first text of each step and the step's tokens; NULL counts as empty."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
        yield at, _analyze_step([t or "" for t in texts.slice(at, to - at).to_pylist()], stop_words)
        at = to


def analyze_batch(texts: pa.Array, stop_words: bool = False) -> pa.ListArray:
    """The tokens of each text, in steps, so that memory beyond the batch and its tokens does not grow with it; NULL counts as empty."""
    return pa.concat_arrays([_analyze_step([], stop_words), *(x for _, x in _steps(texts, stop_words))])


def token_rows(content: DataFrame) -> DataFrame:
    """(doc_id, term, pos, start, end) of every token of (doc_id, text): rows go out step by step, so not even the tokens of a batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _steps(b.column(1), False):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)).take(pc.list_parent_indices(x)), *x.flatten().flatten()], ["doc_id", "term", "pos", "start", "end"])

    return content.select("doc_id", "text").mapInArrow(run, "doc_id long, term string, pos int, start int, end int")


def tokens(text: Column, stop_words: bool = False) -> Column:
    """array<struct<term, pos, start, end>> with UTF-16 offsets."""

    @F.arrow_udf(_TOKENS)
    def run(col: pa.Array) -> pa.Array:
        return analyze_batch(col, stop_words)

    return run(text)


def is_stop_word(word: str | None) -> bool:
    return bool(word) and word.lower() in STOP_WORDS
