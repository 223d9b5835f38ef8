"""Text functions: tokens, stems, keywords, shingles, hashes and token estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def let(value: Column, use) -> Column:
    """``use`` of a value worked out once, however often its lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fields(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """The first suffix rule that fits; words under 4 bytes stay.

    Rules of one last letter stand together, so that a word is compared with
    few of them; rules of different last letters can't fit the same word.
    """
    by_end: dict[str, list] = {}
    for suffix, new, least in W.STEM_RULES:
        by_end.setdefault(suffix[-1], []).append((suffix, new, least))
    size, out = F.octet_length(word), None
    for end, rules in by_end.items():
        own = None
        for suffix, new, least in rules:
            fits, cut = word.endswith(suffix) & (size - len(suffix) >= least), F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(new))
            own = F.when(fits, cut) if own is None else own.when(fits, cut)
        fits = word.endswith(end)
        out = F.when(size < 4, word).when(fits, own.otherwise(word)) if out is None else out.when(fits, own.otherwise(word))
    return out.otherwise(word)


def stem_word(word: str) -> str:
    """The same rules for one word, in tasks that work on batches."""
    size = len(word.encode())
    if size >= 4:
        for suffix, new, least in W.STEM_RULES:
            if word.endswith(suffix) and size - len(suffix) >= least:
                return word[: -len(suffix)] + new
    return word


def stem_sql(word: str) -> str:
    """The same rules as SQL text."""
    out = [f"CASE WHEN strlen({word}) < 4 THEN {word}"]
    for suffix, new, least in W.STEM_RULES:
        quoted = suffix.replace("'", "''")
        out.append(f"WHEN ends_with({word}, '{quoted}') AND strlen({word}) - {len(suffix)} >= {least} THEN left({word}, length({word}) - {len(suffix)}) || '{new}'")
    return " ".join([*out, f"ELSE {word} END"])


def one_of(word: Column, words) -> Column:
    return word.isin(*dict.fromkeys(words))


def index_tokens(text: Column) -> Column:
    """Tokens of two bytes or more that are no stopwords, with repeats, not stemmed."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: (F.octet_length(t) >= 2) & ~one_of(t, W.INDEX_STOPWORDS))


def index_words(text: Column) -> Column:
    """The same, stemmed."""
    return F.transform(index_tokens(text), stem)


def trim_marks(word: Column) -> Column:
    """Without what is neither letter nor number at both ends."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def query_keywords(text: Column) -> Column:
    """In order, with repeats, unstemmed."""
    words = F.transform(fields(F.lower(text)), trim_marks)
    return F.filter(words, lambda t: (F.octet_length(t) >= 2) & ~one_of(t, W.QUERY_STOPWORDS))


def like_terms(text: Column) -> Column:
    """ASCII tokens over two bytes for a search of the turn log."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.octet_length(t) > 2) & ~one_of(t, W.TURN_STOPWORDS))


def rag_keywords(text: Column) -> Column:
    """Distinct, in order."""
    words = F.transform(fields(F.lower(text)), lambda w: F.regexp_replace(w, r"""^[.,!?;:"'()\[\]{}]+|[.,!?;:"'()\[\]{}]+$""", ""))
    return F.array_distinct(F.filter(words, lambda t: (F.octet_length(t) >= 2) & ~one_of(t, W.RAG_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct members: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def trigrams(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of trigrams: 1 if equal, 0 if either has under three bytes."""
    short = (F.octet_length(a) < 3) | (F.octet_length(b) < 3)
    return F.when(a == b, F.lit(1.0)).when(short, F.lit(0.0)).otherwise(jaccard(trigrams(a), trigrams(b)))


def word_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping runs of words; the run that reaches the end is the last."""
    step = size - overlap if size > overlap else size

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")))

    return let(fields(text), cut)


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_key(text: Column) -> Column:
    return F.sha2(ascii_lower(F.trim(text)), 256)


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(32))


def summary_key(text: Column) -> Column:
    return F.sha1(text)


def request_key(text: Column, *images: Column) -> Column:
    """Of a text together with its images."""
    return F.sha2(F.concat(text, *images), 256)


def tokens_ceil_bytes(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def tokens_floor_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def tokens_floor_bytes(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def truncate_tokens(text: Column, n: int) -> Column:
    return F.when(F.octet_length(text) > 4 * n, F.concat(F.left(text, F.lit(4 * n)), F.lit("..."))).otherwise(text)


def contains_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(t) for t in terms], F.lit(False))


def strip_html(html: Column) -> Column:
    no_blocks = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_blocks, r"<[^>]*>", " "), r"\s+", " "))


def answer_contains(text: Column, answer: Column) -> Column:
    return ascii_lower(text).contains(ascii_lower(answer))


def answer_partial(text: Column, words: Column) -> Column:
    """At least half of the answer's words are in the text."""
    low = ascii_lower(text)
    return F.size(F.filter(words, lambda w: low.contains(ascii_lower(w)))) * 2 >= F.size(words)
