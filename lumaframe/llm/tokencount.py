"""Token counts of whole texts by a map-side lookup in two tiers; no pre-token is ever shuffled.

A first pass finds the pre-tokens that are frequent in the whole corpus: every task keeps a Misra-Gries summary
of bounded size, and summaries are merged in two levels. Their lengths in tokens are a compact table, its size
bounded by `KEEP` and `LONGEST`, that is broadcast. In the second pass each pre-token is looked up there; a miss goes
to the worker's cache, and what that lacks is encoded by the library. Which pre-tokens are in the table changes
only the time: a count is always the library's own.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Entries of a summary and of the broadcast table; an entry is at most LONGEST characters, so at most 4 times as
#: many bytes: the table has 2.1 MB at most.
KEEP, LONGEST = 8192, 64
#: Entries of a worker's cache; a text is read in slices of about SLICE characters, cut at spaces.
CACHE_WORDS, SLICE = 300_000, 1 << 20
#: Summaries are merged in so many tasks, then in one.
FAN = 128


def _class(sort: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == sort)


#: Characters that NFC leaves alone, that have one lower-case form and whose class no library sees differently.
PLAIN = re.compile("[\x00-įı-ſ]*")
#: The vocabulary's own pattern for those characters, after lower-casing.
WORD = re.compile(rf"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_class('L')}{_class('N')}]+")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a text that begin at a space or at its start; no pre-token lies across such a cut."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + size) if len(text) - start > size else -1
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def units(part: str) -> list[str]:
    """The pre-tokens of a plain part. Of any other part the pre-tokens of its plain words and, as one unit each,
    its other words, which the library splits itself."""
    if PLAIN.fullmatch(part):
        return WORD.findall(part.lower())
    words = part.split(" ")
    found = WORD.findall(" ".join(w for w in words if PLAIN.fullmatch(w)).lower())
    return found + [w for w in words if not PLAIN.fullmatch(w)]


def shrink(counts: Counter, keep: int = KEEP) -> Counter:
    """Misra-Gries: at most `keep` entries; every entry loses as much as the first that goes has. What occurs in
    more than one part in `keep` of all is never lost, in whatever order summaries are merged."""
    if len(counts) <= keep:
        return counts
    less = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -keep - 1)[-keep - 1]
    return Counter({w: n - int(less) for w, n in counts.items() if n > less})


def _packed(counts: Counter) -> pa.RecordBatch:
    counts = shrink(counts)
    return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["words", "counts"])


def _summarise(batches):
    """Texts of a task to one row, its summary."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for part in slices(text or ""):
                counts.update(units(part))
                if len(counts) > 16 * KEEP:
                    counts = shrink(Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}))
    yield _packed(Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}))


def _merge(batches):
    counts: Counter = Counter()
    for batch in batches:
        for words, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts.update(dict(zip(words, n, strict=True)))
            counts = shrink(counts)
    yield _packed(counts)


def frequent(docs: DataFrame) -> list[str]:
    """Up to KEEP frequent pre-tokens of all texts, most frequent first."""
    kind = "words array<string>, counts array<bigint>"
    parts = docs.select("text").where("text is not null").mapInArrow(_summarise, kind)
    merged = parts.repartition(FAN).mapInArrow(_merge, kind).repartition(1).mapInArrow(_merge, kind).collect()
    counts = Counter({w: n for r in merged for w, n in zip(r.words, r.counts, strict=True)})
    return sorted(counts, key=lambda w: (-counts[w], w))


class Cache(dict):
    """Second tier: units that this worker has encoded; begun anew when full. Long ones aren't kept."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(tokenizer)
        self.full.no_truncation()
        self.full.no_padding()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def encoded(self, text: str) -> int:
        return len(self.full.encode(text, add_special_tokens=False))

    def __missing__(self, unit: str) -> int:
        n = self.encoded(unit)
        if len(unit) <= LONGEST:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[unit] = n
        return n


class Lookup(dict):
    """First tier: lengths of frequent units, then the worker's cache."""

    def __init__(self, known: tuple[bytes, bytes], cache: Cache):
        super().__init__(zip(known[0].decode().split(" "), np.frombuffer(known[1], "<u2").tolist(), strict=True) if known[0] else ())
        self.cache = cache

    def __missing__(self, unit: str) -> int:
        return self.cache[unit]

    def count(self, text: str) -> int:
        if any(s in text for s in self.cache.special):  # found in the raw text, before anything else
            return self.cache.encoded(text)
        return sum(sum(map(self.__getitem__, units(part))) for part in slices(text))


_caches: dict[str, Cache] = {}
_lookups: dict[tuple, Lookup] = {}


def cache(tokenizer: str) -> Cache:
    """One a worker process, kept between tasks."""
    if tokenizer not in _caches:
        _caches[tokenizer] = Cache(tokenizer)
    return _caches[tokenizer]


def lookup(tokenizer: str, known: tuple[bytes, bytes]) -> Lookup:
    key = (tokenizer, *known)
    if key not in _lookups:
        _lookups.clear()
        _lookups[key] = Lookup(known, cache(tokenizer))
    return _lookups[key]


def default_tokenizer() -> str:
    import public_tokenizers as public

    return public.path("word_bpe_49k.json")


def count_tokens(docs: DataFrame, name: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """docs with a further column `name`, long: the tokens of the whole text as the tokenizer's library gives them,
    without added tokens, truncation or padding. Strings of special tokens inside a text are those tokens.

    tokenizer: a file of a vocabulary that drops white space and splits by the pattern of WORD. A null or empty text
    and one of white space alone have 0. Rows are neither dropped nor joined: repeated rows, null ids and other
    columns of any name come back as they are; a column `name` that docs already has is replaced."""
    tokenizer = tokenizer or default_tokenizer()
    words = frequent(docs)
    own = cache(tokenizer)
    lengths = np.array([own[w] for w in words], "<u2")
    known = docs.sparkSession.sparkContext.broadcast((" ".join(words).encode(), lengths.tobytes()))

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        two_tiers = lookup(tokenizer, known.value)
        return pa.array([two_tiers.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(name, tokens("text"))


def op11_tokens(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, "n_tokens")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return out.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
