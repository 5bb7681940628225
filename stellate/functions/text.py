"""Tokenizers, and embedding of documents as sparse vectors by BM25."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Common English words.
ENGLISH = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now".split()
)


def stop_words(language: str) -> frozenset[str]:
    """The common words that Spark knows of a language."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(w.lower() for w in StopWordsRemover.loadDefaultStopWords(language))


@dataclass(frozen=True)
class TextIndex:
    """How a text field is cut into tokens. tokenizer: word (letters and digits), whitespace, prefix (beginnings of words)."""

    tokenizer: str = "word"
    lowercase: bool = True
    min_token_len: int | None = None
    max_token_len: int | None = None
    stopwords: frozenset[str] = field(default_factory=frozenset)
    phrase_matching: bool = False
    stemmer: str | None = None
    ascii_folding: bool = False


def fold(text: str) -> str:
    """Letters without their marks, as far as that makes them ASCII."""
    return "".join(c if c.isascii() else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) or c for c in text)


def tokens(text: Column, how: TextIndex = TextIndex(), query: bool = False) -> Column:
    """The tokens of a text in their order. A query for prefixes keeps whole words."""
    if how.ascii_folding:
        text = F.translate(text, *_folding())
    if how.lowercase:
        text = F.lower(text)
    found = F.split(F.coalesce(text, F.lit("")), r"\s+" if how.tokenizer == "whitespace" else r"[^\p{L}\p{N}]+")
    found = F.filter(found, lambda t: t != "")
    if how.stopwords:
        found = F.filter(found, lambda t: ~t.isin(sorted(how.stopwords)))
    if how.stemmer:
        found = F.element_at(_stems(F.array(found), how.stemmer), 1)
    return _cut(found, how, query)


def _cut(found: Column, how: TextIndex, query: bool = False) -> Column:
    """Words by their lengths, or as prefixes."""
    low, high = how.min_token_len, how.max_token_len
    if how.tokenizer == "prefix":
        if query:
            return F.transform(found, lambda t: F.substring(t, F.lit(1), F.lit(high or 1 << 20))) if high else found
        most = lambda t: F.least(F.length(t), F.lit(high)) if high else F.length(t)
        cut = lambda t: F.when(F.length(t) >= (low or 1), F.transform(F.sequence(F.lit(low or 1), most(t)), lambda n: F.substring(t, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(found, cut))
    if low:
        found = F.filter(found, lambda t: F.length(t) >= low)
    return F.filter(found, lambda t: F.length(t) <= high) if high else found


def tokens_of_each(texts: Column, how: TextIndex) -> Column:
    """The tokens of each text of an array, as an array of arrays."""
    plain = replace(how, stemmer=None, tokenizer="whitespace" if how.tokenizer == "whitespace" else "word", min_token_len=None, max_token_len=None)
    words = F.transform(texts, lambda t: tokens(t, plain))
    words = _stems(words, how.stemmer) if how.stemmer else words
    return F.transform(words, lambda w: _cut(w, how))


def token_list(text: str, how: TextIndex = TextIndex(), query: bool = False) -> list[str]:
    """As tokens, of a text that a request gives."""
    text = "".join(fold(c) if len(fold(c)) == 1 else c for c in text) if how.ascii_folding else text
    text = text.lower() if how.lowercase else text
    found = [t for t in (text.split() if how.tokenizer == "whitespace" else regex.split(r"[^\p{L}\p{N}]+", text)) if t and t not in how.stopwords]
    found = [stem(t, how.stemmer) for t in found] if how.stemmer else found
    low, high = how.min_token_len or 0, how.max_token_len or 1 << 20
    if how.tokenizer == "prefix":
        return [t[:high] for t in found] if query else [t[:n] for t in found for n in range(max(1, low), min(high, len(t)) + 1)]
    return [t for t in found if low <= len(t) <= high]


def _folding() -> tuple[str, str]:
    letters = [chr(n) for n in range(0xC0, 0x250) if len(fold(chr(n))) == 1 and fold(chr(n)).isascii()]
    return "".join(letters), "".join(map(fold, letters))


_VOWELS = "aeiouy"


def _region(word: str, start: int = 0) -> int:
    """Behind the first consonant that follows a vowel."""
    for n in range(start + 1, len(word)):
        if word[n] not in _VOWELS and word[n - 1] in _VOWELS:
            return n + 1
    return len(word)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def english_stem(word: str) -> str:
    """The stem of an English word by the published second Porter algorithm."""
    fixed = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
    if word in fixed:
        return fixed[word]
    if len(word) < 3 or not word.isascii():
        return word
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (n == 0 or w[n - 1] in _VOWELS) else c for n, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w)
    r2 = _region(w, r1) if r1 < len(w) else len(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end in ("eed", "eedly"):
                w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
            elif any(c in _VOWELS for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    w = w[:-1]
                elif len(w) <= r1 and _short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    second = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
    third = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
    for n, rules in enumerate((second, third)):
        for end in sorted([*rules, *(("ogi", "li") if n == 0 else ())], key=len, reverse=True):
            if w.endswith(end):
                at = len(w) - len(end)
                if at >= r1:
                    if end == "ogi":
                        w = w[:-1] if at and w[at - 1] == "l" else w
                    elif end == "li":
                        w = w[:-2] if at and w[at - 1] in "cdeghkmnrt" else w
                    elif end != "ative" or at >= r2:
                        w = w[:at] + rules[end]
                break
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or at and w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _suffix_stem(endings: tuple[str, ...]):
    """A light stemmer: the longest of some endings is taken off if a stem of three letters is left."""
    ordered = sorted(endings, key=len, reverse=True)

    def stem_of(word: str) -> str:
        return next((word[: -len(e)] for e in ordered if word.endswith(e) and len(word) - len(e) >= 3), word)

    return stem_of


# Common inflectional endings, for light stemming.
_ENDINGS = {
    "german": "e en er em es ern s n st",
    "french": "e es s ent er ez ée ées és é aient ait ais ons",
    "spanish": "o a os as e es ar er ir ado ada ados adas ando iendo",
    "italian": "o a i e are ere ire ato ata ati ate ando endo",
    "portuguese": "o a os as e es ar er ir ado ada ados adas ando endo",
    "dutch": "e en s t er eren",
    "swedish": "a e ar er or en et arna erna orna s",
    "norwegian": "a e er en et ene ers s",
    "danish": "e er en et ene erne s",
    "finnish": "a ä n t ssa ssä sta stä lla llä lta ltä lle in en",
    "hungarian": "k ok ek ök ban ben nak nek val vel t at et ot",
    "romanian": "ul ului ii ilor a e i le lor",
    "russian": "а я о е ы и у ю ой ей ом ем ам ям ами ями ах ях ого его ому ему ый ий ая яя ое ее ые ие ых их",
    "greek": "α ας ες η ης ο ος ου οι ων ους ι ια ιου",
    "turkish": "lar ler ı i u ü da de dan den nın nin",
    "arabic": "ة ه ها ات ون ين ان ية",
}


def stem(word: str, language: str) -> str:
    """English by the published algorithm; other languages by taking off a common ending."""
    return _stemmer(language)(word)


@lru_cache(maxsize=None)
def _stemmer(language: str):
    if language == "english":
        return english_stem
    if language not in _ENDINGS:
        raise ValueError(f"no stemmer of {language!r}; there are {['english', *sorted(_ENDINGS)]}")
    return _suffix_stem(tuple(_ENDINGS[language].split()))


def _stems(words: Column, language: str) -> Column:
    """Of lists of words."""
    stem_of = _stemmer(language)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def stems(rows: pa.Array) -> pa.Array:
        known: dict[str, str] = {}

        def of(w: str) -> str:
            if (s := known.get(w)) is None:
                s = known[w] = stem_of(w)
            return s

        return pa.array([None if x is None else [[of(w) for w in y] for y in x] for x in rows.to_pylist()], pa.list_(pa.list_(pa.string())))

    return stems(words)


def murmur3(data: bytes, seed: int = 0) -> int:
    """The 32-bit hash of the public MurmurHash3."""
    mask, h = 0xFFFFFFFF, seed
    rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    whole = len(data) // 4 * 4
    for n in range(0, whole, 4):
        k = rotate(int.from_bytes(data[n : n + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= rotate(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


@lru_cache(maxsize=1 << 17)
def token_id(token: str) -> int:
    h = murmur3(token.encode())
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def bm25_weights(words: Column, k: float = 1.2, b: float = 0.75, avg_len: float = 256.0) -> Column:
    """(token, weight) of each different token of a document."""
    size = F.size(words).cast("double")
    count = lambda t: F.size(F.filter(words, lambda x: x == t)).cast("double")
    weight = lambda t: count(t) * (k + 1) / (count(t) + k * (1 - b + b * size / avg_len))
    return F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("token"), weight(t).alias("weight")))


def bm25_vector(text: str, options: dict | None = None) -> dict:
    """The sparse vector of a text as a query: each different token weighs 1. options: the fields of a TextIndex, language among them."""
    given = dict(options or {})
    language = given.pop("language", None)
    how = TextIndex(**{**({"stemmer": language, "stopwords": stop_words(language)} if language else {}), **given})
    ids = sorted({token_id(t) for t in token_list(text, how)})
    return {"indices": ids, "values": [1.0] * len(ids)}


_SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])


def bm25_embedding(words: Column, k: float = 1.2, b: float = 0.75, avg_len: float = 256.0, query: bool = False) -> Column:
    """A sparse vector of a document's tokens, indexed by their hashes; a query weighs each token 1."""

    @F.arrow_udf(_SPARSE)
    def embed(lists: pa.Array) -> pa.Array:
        out = []
        for words in lists.to_pylist():
            ids, counts = np.unique(np.array([token_id(w) for w in words or []], np.int64), return_counts=True)
            n = counts.astype(np.float64)
            value = np.ones(len(n)) if query else n * (k + 1) / (n + k * (1 - b + b * n.sum() / avg_len))
            out.append({"indices": ids.tolist(), "values": value.tolist()})
        return pa.array(out, pa.struct([("indices", pa.list_(pa.int64())), ("values", pa.list_(pa.float32()))]))

    return embed(words)
