"""Text column functions: tokens, sentences, chunks, language codes, Unicode forms. All but ``nfc`` are built-ins."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Sorted by length, then alphabetically.
STOP_WORDS = ("a", "an", "as", "at", "be", "by", "if", "in", "is", "it", "no", "of", "on", "or", "to", "and", "are", "but", "for", "not", "the", "was", "into", "such", "that", "then", "they", "this", "will", "with", "their", "there", "these", "were")
#: (ISO 639-3 code, ISO 639-1 code, English name)
LANGUAGES = (
    ("arb", "ar", "arabic"), ("ben", "bn", "bengali"), ("deu", "de", "german"), ("eng", "en", "english"), ("fra", "fr", "french"), ("hin", "hi", "hindi"),
    ("ind", "id", "indonesian"), ("ita", "it", "italian"), ("jpn", "ja", "japanese"), ("kan", "kn", "kannada"), ("kor", "ko", "korean"), ("mal", "ml", "malayalam"),
    ("mar", "mr", "marathi"), ("por", "pt", "portuguese"), ("rus", "ru", "russian"), ("spa", "es", "spanish"), ("tam", "ta", "tamil"), ("tel", "te", "telugu"),
    ("tur", "tr", "turkish"), ("urd", "ur", "urdu"), ("vie", "vi", "vietnamese"), ("zho", "zh", "chinese"),
)
_SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def tokens(text: Column, stop_words: bool = True) -> Column:
    """Lower-cased runs of letters, numbers and underscores; without stop words unless asked otherwise (F1, F2)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop_words else found


def bigrams(words: Column) -> Column:
    """``a_b`` of neighbours."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws("_", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_lang(value: Column) -> Column:
    """ISO 639-3 code of a code or English name; other values only trimmed and lower-cased."""
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    known = {short: code for code, short, _ in LANGUAGES} | {name: code for code, _, name in LANGUAGES}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[v], v)


def sentences(text: Column) -> Column:
    """Sentences of a passage: cut after ``.!?`` and at newlines."""
    return F.split(text, _SENTENCE_END + r"|\n+")


def lexical_cosine(q: Column, s: Column) -> Column:
    """Cosine of two token sets (F13); both arrays distinct."""
    return F.size(F.array_intersect(q, s)) / (F.sqrt(F.size(q).cast("double")) * F.sqrt(F.size(s).cast("double")))


def overlap_tail(text: Column, overlap: int) -> Column:
    """The last ``overlap`` characters from the first word start on; nothing of a text that is no longer (F8)."""
    if overlap <= 0:
        return F.lit("")
    tail = F.right(text, F.lit(overlap))
    return F.when(F.length(text) <= overlap, "").otherwise(F.substr(tail, F.locate(" ", tail) + 1))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of a text: paragraphs packed greedily up to ``size``, oversize ones by sentence.

    One fold over pieces: a piece is a paragraph, or a sentence of an oversize paragraph. No overlap crosses an oversize
    paragraph.
    """
    whole = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    paragraphs = F.transform(F.split(whole, r"(?U)\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"[ \t]+", " ")))
    paragraphs = F.filter(paragraphs, lambda p: p != "")

    def cut(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / size).cast("int") - 1), lambda i: F.substr(s, i * size + 1, F.lit(size)))
        return F.when(F.length(s) <= size, F.array(s)).otherwise(parts)

    # A piece without text closes the chunk before it; sentences of an oversize paragraph stand between two of those.
    piece = lambda t, sep: F.struct(t.alias("t"), F.lit(sep).alias("sep"))
    close = F.array(piece(F.lit(None).cast("string"), ""))

    def pieces(p: Column) -> Column:
        parts = F.flatten(F.transform(F.split(p, _SENTENCE_END), cut))
        return F.when(F.length(p) > size, F.concat(close, F.transform(parts, lambda s: piece(s, " ")), close)).otherwise(F.array(piece(p, "\n\n")))

    def state(out: Column, buf: Column) -> Column:
        return F.struct(out.alias("out"), buf.alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        tail = overlap_tail(acc.buf, overlap)
        fresh = F.when(tail == "", p.t).otherwise(F.concat(tail, p.sep, p.t))
        flushed = F.array_append(acc.out, acc.buf)
        return (
            F.when(p.t.isNull(), state(F.when(acc.buf == "", acc.out).otherwise(flushed), F.lit("")))
            .when(acc.buf == "", state(acc.out, p.t))
            .when(F.length(acc.buf) + F.length(p.sep) + F.length(p.t) <= size, state(acc.out, F.concat(acc.buf, p.sep, p.t)))
            .otherwise(state(flushed, fresh))
        )

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(F.flatten(F.transform(paragraphs, pieces)), start, step, lambda acc: F.when(acc.buf == "", acc.out).otherwise(F.array_append(acc.out, acc.buf)))


def nfc(text: Column) -> Column:
    """Normal form C of stripped text (F10): Spark has no built-in for it, so an Arrow UDF."""

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.strip()))

    return normal(text)
