"""Quality rules: counts of symbols and repeats, and tokeniser fertility.

Fertility is measured with two public vocabularies. One with byte fallback
gives characters per token, the share of tokens that are single fallback bytes
and the entropy of the text's token distribution; one for many languages gives
characters per token again, by other merges. Each figure is held against bands
of the text's language or else of its script. Words are tokenised one by one
(pieces of these vocabularies don't span white space), each different word of
a text once, and a bounded memo serves most of them.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, alone, blocks, fields, keeps, unused

FALLBACK_VOCABULARY, MANY_LANGUAGES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: Per language: least and most characters per token, most share of fallback
#: bytes, least and most bits of token entropy, least and most characters per
#: token of the vocabulary for many languages. The lower bounds are the 0.5 %
#: quantiles of documents labelled quality 1 with even ids at sf0.1; junk lies
#: below, none of it above.
BANDS = {
    "en": (2.09, 8.0, 0.10, 5.77, 14.0, 2.10, 8.0),
    "fr": (1.76, 8.0, 0.10, 5.76, 14.0, 1.88, 8.0),
    "de": (2.07, 8.0, 0.10, 5.80, 14.0, 2.17, 8.0),
    "es": (1.80, 8.0, 0.10, 5.81, 14.0, 1.91, 8.0),
}
#: By script, for texts of any other or no language.
SCRIPT_BANDS = {
    "latin": (1.2, 10.0, 0.15, 4.0, 14.0, 1.2, 10.0),
    "other": (0.25, 6.0, 0.80, 3.0, 14.0, 0.25, 8.0),
}
#: A text of n tokens has at most log2(n) bits of entropy: below this many tokens, the least entropy falls in proportion to that.
WHOLE_TOKENS = 64
#: Words whose pieces a worker remembers at the utmost: two blocks of text have fewer.
WORDS_KEPT = 2_000_000

_NOT_COUNTED = bytes(range(9, 14)) + b" " + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@lru_cache(maxsize=1)
def _pieces() -> tuple[Memo, Callable, np.ndarray]:
    """Of a word: its pieces with byte fallback, their number, and how many tokens the other vocabulary needs; the same of a list; and which pieces are bytes."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(FALLBACK_VOCABULARY))
    with open(public_tokenizers.path(MANY_LANGUAGES), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    other = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def told(words: list[bytes]) -> list[tuple[bytes, int, int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = model.encode(texts, num_threads=1)
        return [(array("i", i).tobytes(), len(i), len(n)) for i, n in zip(ids, (other.encode_ordinary(f" {t}") for t in texts))]

    return Memo(lambda word: told([word])[0], WORDS_KEPT), told, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


keeps("quality", _pieces.cache_clear)


def learn(texts: list[bytes]) -> None:
    """Tokenise all words of a block that aren't known yet at once; words of this block and of the one before stay known."""
    memo, told, _ = _pieces()
    words = set().union(*(t.split() for t in texts))
    held = {w: v for w in words if (v := memo.get(w) or memo.before.get(w))}
    new = list(words.difference(held))
    for at in range(0, len(new), 10_000):
        held.update(zip(new[at : at + 10_000], told(new[at : at + 10_000])))
    memo.before = dict(memo)
    memo.clear()
    memo.update(held)


def repeated_words(ids: np.ndarray, n: int = 3) -> int:
    """Words inside windows of ``n`` words that occur twice or more."""
    if len(ids) <= n:
        return 0
    codes = ids[: len(ids) - n + 1].astype(np.int64)
    for k in range(1, n):
        codes = np.unique(codes, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[k : len(ids) - n + 1 + k]
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(n):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def fertility(words: list[bytes], times: np.ndarray, word_chars: int) -> tuple[int, float, float, float, float]:
    """Of different words, each so many times: tokens, characters per token, share of fallback bytes, bits of entropy, and characters per token of the other vocabulary."""
    memo, _, byte_ids = _pieces()
    if not words:
        return 0, 0.0, 0.0, 0.0, 0.0
    pieces, lengths, others = zip(*map(memo.__getitem__, words))
    ids = np.frombuffer(b"".join(pieces), np.int32)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0, 0.0
    weights = np.repeat(times, lengths)
    total = int(weights.sum())
    counts = np.bincount(ids, weights)
    share = counts[counts > 0] / total
    tokens = int(np.array(others, np.int64) @ times)
    return total, word_chars / total, float(weights[byte_ids[ids]].sum() / total), float(-(share * np.log2(share)).sum()), word_chars / max(1, tokens)


def band(lang: str | None, text: bytes) -> tuple[float, ...]:
    if lang in BANDS:
        return BANDS[lang]
    high = len(text) - len(text.translate(None, bytes(range(0xC4, 0x100))))  # first bytes beyond Latin-1
    return SCRIPT_BANDS["other" if 4 * high > len(text) else "latin"]


def measure(text: bytes, lang: str | None = None) -> dict:
    """All figures of one text and the verdict."""
    words = text.split()
    index = dict.fromkeys(words)
    index = dict(zip(index, range(len(index))))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    chars = len(text.translate(None, _NOT_COUNTED))
    repeats = repeated_words(ids)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
    tokens, per_token, fallback, entropy, per_other = fertility(list(index), np.bincount(ids, minlength=len(index)), chars)
    least, most, bytes_most, low, high, other_least, other_most = band(lang, text)
    low *= min(1.0, np.log2(max(1, tokens)) / np.log2(WHOLE_TOKENS))
    verdict = bool(least <= per_token <= most and fallback <= bytes_most and low <= entropy <= high and other_least <= per_other <= other_most)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeats, "base_failed": base_failed,
        "kept": not base_failed and verdict, "tokens": tokens, "chars_per_token": per_token,
        "fallback_share": fallback, "token_entropy": entropy, "chars_per_other_token": per_other,
    }


_SPARK, _ARROW = fields(
    "n_words:long word_chars:long n_symbols:long n_dup_lines:long n_repeat_words:long base_failed:boolean kept:boolean "
    "tokens:long chars_per_token:double fallback_share:double token_entropy:double chars_per_other_token:double"
)


@F.arrow_udf(_SPARK)
def _measure(texts: pa.Array, langs: pa.Array) -> pa.Array:
    alone("quality")
    langs, out = iter(langs.to_pylist()), []
    for block in blocks(texts):
        learn(block)
        out += [measure(t, next(langs)) for t in block]
    return pa.array(out, pa.struct(_ARROW))


def quality_rules(docs: DataFrame, text: str = "text", lang: str | None = "lang", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column of the figures and the verdict of each whole text.

    A null or empty text counts as one without words and fails. A null or
    unknown language falls back to the bands of its script. Rows and other
    columns stay; an existing column ``into`` is replaced.
    """
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return docs.withColumn(into, _measure(F.col(text), language))


def quality_filter(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the columns they came with."""
    mark = unused("quality", docs)
    return quality_rules(docs, text, lang, mark).where(F.col(f"{mark}.kept")).drop(mark)
