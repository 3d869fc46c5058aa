"""Language-model scores of a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts a word from the vectors of the words before it, each multiplied by a matrix of its place
(kept as one table a place). Words are scored in two steps, both by vectors: P(word) = P(class | context) *
P(word | class, context). The most frequent words and the end of the text are classes of their own, the other
words are grouped by their first letters; in a group each kept word has its vector, and one more stands for
all words that aren't kept, among which counts decide. Both softmaxes are normalised by batched matrix
products. How many words are kept grows with the corpus, as the square root of its tokens.

Counts cover all training texts. Words of at least a certain count (at most TOP of them) and the end are
broadcast; the others are joined. Training tasks start from the same parameters and learn from every position
of their own rows; the model is the mean of what they learned of each row of the tables, by its uses.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, crc_mod, staged, table

TOP = 200_000  #: words broadcast with their counts, at most
LEAST_KEPT, MOST_KEPT = 2000, 100_000  #: bounds of the number of words with vectors of their own
OWN = 63  #: words that are a class of their own, beside the end
HASHED = 256  #: context vectors that the other words share by hash
DIM, ORDER = 12, 3  #: size of a vector; words of context
NOISE, INNER = 32, 2  #: noise classes of a step, shared by its positions; noise words of a position
RATE, CHUNK, HELD = 0.15, 4096, 65_536
END = b" "  #: no word holds a space


def short(word: bytes) -> bytes:
    """The word, or a 128-bit hash after a space if it has over 24 bytes."""
    return word if len(word) <= 24 else b" " + xxhash.xxh3_128_digest(word)


def keys(text: bytes | None) -> list[bytes]:
    """Words, long ones by their hash, and the end."""
    w = (text or b"").translate(ASCII_LOWER).split()
    if max(map(len, w), default=0) > 24:
        w = [short(x) for x in w]
    w.append(END)
    return w


def count_words(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """(key, n) over all texts; tasks add up before the shuffle and hold at most about flush keys."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(keys(text))
                if len(seen) >= flush:
                    yield from out()
        yield from out()

    return texts.select("text").mapInArrow(run, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of broadcast words, what each of them means to the model, and where the tables' rows are.

    A token's code is its word's number or, if that isn't broadcast, -1 - (hashed * group + hash). Rows of
    the model: ORDER tables of contexts (kept words, hashed ones, the start), classes, and words of groups."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int, by_letters: dict[int, tuple[int, int]]):
        words = sorted(words, key=lambda x: (-x[1], x[0]))
        self.own, self.hashed = OWN, HASHED
        self.index = {w: i for i, (w, _) in enumerate(words)}
        count = np.array([n for _, n in words] or [0], np.float64)
        self.log = np.log10(count + 1)
        self.base = np.log10(total + distinct + 1)
        self.kept = min(len(words), kept_words(total))
        self.groups = group_count(self.kept)
        self.classes = self.own + 1 + self.groups
        n = max(1, len(words))
        self.ctx, self.cls, self.out = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        mass, members = np.zeros(self.classes), [[] for _ in range(self.groups)]
        owned = 0
        for i, (w, c) in enumerate(words):
            self.ctx[i] = i if i < self.kept else self.kept + zlib.crc32(w) % self.hashed
            if w == END:
                self.cls[i] = self.own
            elif owned < self.own and i < self.kept:
                self.cls[i] = owned
                owned += 1
            else:
                g = zlib.crc32(w[:3]) % self.groups
                self.cls[i] = self.own + 1 + g
                if i < self.kept:
                    members[g].append(i)
            mass[self.cls[i]] += c
        # the rest of each group: all words of its letters but those that have a place of their own
        self.first = np.cumsum([0, *(len(m) + 1 for m in members)])
        inner, self.rest = np.zeros(self.first[-1]), np.zeros(self.groups)
        for g, m in enumerate(members):
            for k, i in enumerate(m):
                self.out[i] = self.first[g] + k
                inner[self.first[g] + k] = count[i]
        left = {g: list(by_letters.get(g, (0, 0))) for g in range(self.groups)}
        for i, (w, c) in enumerate(words):
            if w != END and (self.cls[i] < self.own or self.out[i] >= 0):
                own = left[zlib.crc32(w[:3]) % self.groups]
                own[0] -= c
                own[1] -= 1
        for g, (n_left, v_left) in left.items():
            last = self.first[g + 1] - 1
            inner[last] = n_left
            self.rest[g] = np.log10(n_left + v_left + 1)
            mass[self.own + 1 + g] = inner[self.first[g] : last + 1].sum()
        grouped = self.cls > self.own
        self.is_rest = grouped & (self.out < 0)
        self.out[self.is_rest] = self.first[self.cls[self.is_rest] - self.own] - 1
        self.share = (mass + 1) / (mass + 1).sum()
        self.inner = inner + 1
        self.inner_ends = np.cumsum(self.inner)
        self.start = self.kept + self.hashed
        self.q = ORDER * (self.start + 1)
        self.w = self.q + self.classes
        self.rows = self.w + len(inner)

    def numbers(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context row, class and word of the group (-1 for a class of one word) of each token."""
        known, other = np.maximum(code, 0), -1 - np.minimum(code, -1)
        group, unknown = other // self.hashed, code < 0
        ctx = np.where(unknown, self.kept + other % self.hashed, self.ctx[known])
        cls = np.where(unknown, self.own + 1 + group, self.cls[known])
        return ctx, cls, np.where(unknown, self.first[np.minimum(group, self.groups - 1) + 1] - 1, self.out[known])


def kept_words(total: int) -> int:
    """Words with vectors of their own: half the square root of the training tokens, within bounds."""
    return int(min(max(0.5 * total**0.5, LEAST_KEPT), MOST_KEPT))


def group_count(kept: int) -> int:
    return max(8, int(kept**0.5))


def encode(vocab: Vocabulary, text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the words and the end, and the keys of words that aren't broadcast."""
    w = (text or b"").translate(ASCII_LOWER).split()
    w.append(END)
    get = vocab.index.get
    code, rare = np.fromiter(map(get, w, repeat(-1)), np.int32, len(w)), []
    for at in np.flatnonzero(code < 0).tolist():
        x = short(w[at])
        code[at] = get(x, -1)
        if code[at] < 0:
            rare.append(x)
            code[at] = -1 - (vocab.hashed * (zlib.crc32(x[:3]) % vocab.groups) + zlib.crc32(x) % vocab.hashed)
    return code, rare


def contexts(vocab: Vocabulary, ctx: np.ndarray) -> np.ndarray:
    """(position, place): the rows of the ORDER words before each position."""
    padded = np.concatenate((np.full(ORDER, vocab.start, np.int64), ctx[:-1]))
    return np.stack([padded[ORDER - 1 - k : len(padded) - k] + k * (vocab.start + 1) for k in range(ORDER)], axis=1)


def start(vocab: Vocabulary, seed: int = 42) -> np.ndarray:
    """The tables, one under the other; the last column is the bias."""
    p = np.random.default_rng(seed).normal(0, 0.1, (vocab.rows, DIM + 1)).astype(np.float32)
    p[:, DIM] = 0
    p[vocab.q : vocab.w, DIM] = np.log(vocab.share)
    of = np.add.reduceat(vocab.inner, vocab.first[:-1])
    p[vocab.w :, DIM] = np.log(vocab.inner / np.repeat(of, np.diff(vocab.first)))
    return p


def hidden_of(p: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The predicted vector of each position; its last number, 1, takes the bias."""
    h = p[context[:, 0]]
    for k in range(1, ORDER):
        h += p[context[:, k]]
    h[:, DIM] = 1
    return h


class Learner:
    """The parameters of one task, by AdaGrad; `used` counts the positions that changed a row."""

    def __init__(self, vocab: Vocabulary, seed: int = 42):
        self.vocab, self.p, self.rng = vocab, start(vocab, seed), np.random.default_rng(seed)
        self.squares, self.used = np.zeros_like(self.p), np.zeros(vocab.rows, np.int64)

    def _change(self, rows: np.ndarray, gradients: np.ndarray) -> None:
        order = _order(rows)
        rows = rows[order]
        first = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1))
        g, at = np.add.reduceat(gradients[order], first, axis=0), rows[first]
        self.used[at] += np.diff(first, append=len(rows))
        s = self.squares[at]
        s += g * g
        self.squares[at] = s
        s += 1
        np.sqrt(s, out=s)
        g *= RATE
        g /= s
        self.p[at] -= g

    def step(self, context: np.ndarray, cls: np.ndarray, out: np.ndarray) -> None:
        """One step of noise-contrastive estimation. Noise classes go by their share and serve all positions;
        noise words of a position go by their share in its class."""
        v, p = self.vocab, self.p
        hidden = hidden_of(p, context)
        noise = self.rng.choice(v.classes, NOISE, p=v.share)
        expected = np.log(NOISE * v.share).astype(np.float32)
        target, others = p[v.q + cls], p[v.q + noise]
        up = _sigmoid((hidden * target).sum(1) - expected[cls]) - 1
        down = hidden @ others.T
        down -= expected[noise]
        down = _sigmoid(down)
        back = down @ others
        back += up[:, None] * target

        at = np.flatnonzero(out >= 0)
        if len(at):
            g, h = cls[at] - v.own - 1, hidden[at]
            low, high = v.first[g], v.first[g + 1] - 1
            before = np.where(low > 0, v.inner_ends[low - 1], 0)
            mass = v.inner_ends[high] - before
            drawn = np.searchsorted(v.inner_ends, before[:, None] + self.rng.random((len(at), INNER)) * mass[:, None], side="right")
            picked = np.concatenate((out[at][:, None], np.clip(drawn, low[:, None], high[:, None])), axis=1)
            words = p[v.w + picked]
            score = np.einsum("nkd,nd->nk", words, h) - np.log(INNER * v.inner[picked] / mass[:, None]).astype(np.float32)
            delta = _sigmoid(score)
            delta[:, 0] -= 1
            back[at] += np.einsum("nk,nkd->nd", delta, words)
            self._change((v.w + picked).ravel(), (delta[:, :, None] * h[:, None, :]).reshape(-1, DIM + 1))
        self._change(v.q + np.concatenate((cls, noise)), np.concatenate((up[:, None] * hidden, down.T @ hidden)))
        back[:, DIM] = 0
        for k in range(ORDER):
            self._change(context[:, k], back)


def _order(rows: np.ndarray) -> np.ndarray:
    """What sorts the rows; those of one table mostly lie within 16 bits, which numpy sorts digit by digit."""
    low = rows.min()
    near = rows.max() - low < 1 << 16
    return np.argsort((rows - low).astype(np.uint16) if near else rows, kind="stable")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1
    return np.divide(1, out, out=out)


VALUES = [f"v{k}" for k in range(DIM + 1)]


def learned_rows(coded: DataFrame, vocab_blob, seed: int = 42) -> DataFrame:
    """coded: codes of texts. (row, used, v0, v1, ...): what each task has learned, the rows that it used."""

    def run(batches):
        vocab = vocab_blob.value
        learner, waiting, held = Learner(vocab, seed), [], 0

        def steps():
            whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            for at in range(0, len(whole[0]), CHUNK):
                learner.step(*(x[at : at + CHUNK] for x in whole))
            waiting.clear()

        for batch in batches:
            for code in batch.column(0).to_pylist():
                ctx, cls, out = vocab.numbers(np.frombuffer(code, np.int32))
                waiting.append((contexts(vocab, ctx), cls, out))
                held += len(cls)
                if held >= HELD:
                    steps()
                    held = 0
        if waiting:
            steps()
        rows = np.flatnonzero(learner.used)
        columns = [pa.array(rows, pa.int64()), pa.array(learner.used[rows]), *(pa.array(learner.p[rows, k]) for k in range(DIM + 1))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "used", *VALUES])

    return coded.select("codes").mapInArrow(run, "row bigint, used bigint, " + ", ".join(f"{v} float" for v in VALUES))


def train(coded: DataFrame, vocab_blob, seed: int = 42) -> np.ndarray:
    """The mean of the tasks' parameters, each row by the positions that used it; unused rows stay at their start."""
    mean = [(F.sum(F.col(v).cast("double") * F.col("used")) / F.sum("used")).cast("float").alias(v) for v in VALUES]
    got = learned_rows(coded, vocab_blob, seed).groupBy("row").agg(*mean).toPandas()
    p = start(vocab_blob.value, seed)
    p[got["row"].to_numpy(np.int64)] = got[VALUES].to_numpy(np.float32)
    return p


def _log_softmax(hidden: np.ndarray, words: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural log of the softmax over all rows of `words`, at the chosen ones; in blocks that fit a core's cache."""
    out, turned = np.empty(len(chosen), np.float32), np.ascontiguousarray(words.T)
    size = np.sqrt((hidden * hidden).sum(1).max(initial=0) * (words * words).sum(1).max(initial=0))
    block = max(64, 200_000 // max(1, len(words)))
    for at in range(0, len(chosen), block):
        logits = hidden[at : at + block] @ turned
        if size > 60:  # else no exponential can overflow
            logits -= logits.max(1, keepdims=True)
        named = logits[np.arange(len(logits)), chosen[at : at + block]]
        np.exp(logits, out=logits)
        out[at : at + block] = named - np.log(logits.sum(1))
    return out


def log_words(p: np.ndarray, vocab: Vocabulary, context: np.ndarray, cls: np.ndarray, out: np.ndarray) -> np.ndarray:
    """log10 P(class | context) P(word | class, context), both normalised; a word that isn't kept counts as its
    group's rest."""
    hidden = hidden_of(p, context)
    total = _log_softmax(hidden, p[vocab.q : vocab.w], cls).astype(np.float64)
    inside = np.flatnonzero(out >= 0)
    order = inside[np.argsort(cls[inside], kind="stable")]
    group = cls[order] - vocab.own - 1
    ends = np.searchsorted(group, np.arange(vocab.groups + 1))
    for g in np.flatnonzero(np.diff(ends)).tolist():
        own = order[ends[g] : ends[g + 1]]
        total[own] += _log_softmax(hidden[own], p[vocab.w + vocab.first[g] : vocab.w + vocab.first[g + 1]], out[own] - vocab.first[g])
    return total / np.log(10)


def gather(learned: DataFrame, top: int = TOP):
    """Counts over all of `learned`: (counts as a staged table, least broadcast count, N, Vocabulary)."""
    counts = staged(count_words(learned), "counts")
    by_n = counts.groupBy("n").count().orderBy(F.desc("n")).limit(top).collect()
    # above the highest count, which more than `top` words may share
    least, words = by_n[0]["n"] + 1 if by_n else 1, 0
    for r in by_n:
        words += r["count"]
        if words > top:
            break
        least = r["n"]
    broadcast = [(bytes(r.key), r.n) for r in counts.where((F.col("n") >= least) | (F.col("key") == F.lit(END))).collect()]
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    letters = F.crc32(F.substring("key", 1, 3)) % group_count(min(len(broadcast), kept_words(total)))
    by_letters = counts.where(F.col("key") != F.lit(END)).groupBy(letters.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    return counts, least, total, Vocabulary(broadcast, total, distinct, {r.g: (r.n, r.v) for r in by_letters})


NAMES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_texts(docs: DataFrame, learn: Column | None = None, top: int = TOP) -> DataFrame:
    """docs without their text, with n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (the model's),
    both log10 probabilities of the whole text and its end.

    learn: true for the rows to learn from (none given: all; null: no). A null or empty text is its end
    alone; with nothing to learn from, every word is unseen. Repeated rows are scored each; columns of these
    names are replaced."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.struct(*[c for c in docs.columns if c not in NAMES]).alias("row"),
        F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn"),
    )
    counts, least, total, vocab = gather(rows.where("learn").select("row.text"), top)
    vocab_blob = spark.sparkContext.broadcast(vocab)
    kind = pa.struct({
        "codes": pa.binary(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "inner": pa.float64(),
        "rare": pa.list_(pa.struct({"key": pa.binary(), "n": pa.int64()})),
    })

    @F.arrow_udf("struct<codes:binary, n:bigint, known:bigint, base:double, inner:double, rare:array<struct<key:binary, n:bigint>>>")
    def coded(texts: pa.Array) -> pa.Array:
        vocab, out = vocab_blob.value, []
        for text in texts.cast(pa.binary()).to_pylist():
            code, rare = encode(vocab, text)
            i = code[code >= 0]
            # what the words have among the rest of their groups, but for the logarithms of joined counts
            groups = np.concatenate((vocab.cls[i[vocab.is_rest[i]]] - vocab.own - 1, (-1 - code[code < 0]) // vocab.hashed))
            inner = vocab.log[i[vocab.is_rest[i]]].sum() - vocab.rest[groups].sum()
            out.append({
                "codes": code.tobytes(), "n": len(code), "known": len(i), "base": float(vocab.log[i].sum()) - len(code) * float(vocab.base),
                "inner": float(inner), "rare": [{"key": k, "n": n} for k, n in Counter(rare).items()],
            })
        return pa.array(out, kind)

    rows = rows.withColumn("m", coded("row.text")).withColumn("row", F.col("row").dropFields("text"))
    rows = staged(rows.select("uid", "row", "learn", "m.*"), "codes")
    model = spark.sparkContext.broadcast(train(rows.where("learn"), vocab_blob))

    @F.arrow_udf("double")
    def measure(codes: pa.Array) -> pa.Array:
        vocab, p, out, parts, held = vocab_blob.value, model.value, [], [], 0

        def done():
            lengths = [len(x[1]) for x in parts]
            logs = log_words(p, vocab, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            out.extend(np.add.reduceat(logs, np.cumsum([0, *lengths[:-1]])).tolist())
            parts.clear()

        for code in codes.to_pylist():
            ctx, cls, word = vocab.numbers(np.frombuffer(code, np.int32))
            parts.append((contexts(vocab, ctx), cls, word))
            held += len(cls)
            if held >= 2 * HELD:
                done()
                held = 0
        if parts:
            done()
        return pa.array(out, pa.float64())

    rare = rows.select("uid", F.explode("rare").alias("x")).select("uid", "x.key", F.col("x.n").alias("times"))
    more = rare.join(counts.where(F.col("n") < least), "key").groupBy("uid").agg(
        F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log")
    )
    log, times = F.coalesce("log", F.lit(0.0)), F.coalesce("times", F.lit(0))
    scored = rows.select("uid", "row", "n", "known", "base", (measure("codes") + F.col("inner")).alias("model"))
    return scored.join(more, "uid", "left").select(
        "row.*", F.col("n").alias("n_tokens"), (F.col("known") + times).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score"),
    )


def op7_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = crc_mod(F.col("doc_id"), 7)
    out = score_texts(docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))), rest != 2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
