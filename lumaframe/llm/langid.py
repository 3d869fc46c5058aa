"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time on a bounded sample of labelled rows.
It labels every byte of a text; the mean of the bytes' probabilities gives the document's language. Texts
are cut into segments so that many run side by side. A segment's states start in the neighbouring segments,
OVERLAP bytes before its first byte and after its last one, so that they have settled when they count.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forget, staged, table

HIDDEN, SEGMENT, OVERLAP = 6, 1024, 64
#: Bytes (lanes times steps) that run side by side; only speed depends on it.
CELLS = 1 << 20
#: At most so many labelled texts of a language, all different, are learned from.
ROWS_PER_LANG = 500
STEPS, BATCH, LENGTH, RATE = 300, 160, 48, 0.02
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def start(classes: int, seed: int = 42) -> dict[str, np.ndarray]:
    """x: input weights of the gates (update, reset, new) by byte and direction; u: recurrent weights; v, c: output."""
    rng, h = np.random.default_rng(seed), HIDDEN
    return {
        "x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
        "u": rng.normal(0, h**-0.5, (2, h, 3 * h)).astype(np.float32),
        "v": rng.normal(0, 0.3, (2 * h, classes)).astype(np.float32),
        "c": np.zeros(classes, np.float32),
    }


def states(p: dict, side: int, text: np.ndarray, inside: np.ndarray | None, tape: list | None = None) -> np.ndarray:
    """Hidden states (time, lane, unit) of one direction. text: bytes by (time, lane); inside: 1.0 where a
    lane has a byte; tape: gets what backpropagation needs."""
    steps, lanes = text.shape
    h, u = HIDDEN, p["u"][side]
    out = np.empty((steps, lanes, h), np.float32)
    state = np.zeros((lanes, h), np.float32)
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        gates = p["x"][side][text[t]]
        own = state @ u
        zr = _sigmoid(gates[:, : 2 * h] + own[:, : 2 * h])
        new = np.tanh(gates[:, 2 * h :] + zr[:, h:] * own[:, 2 * h :])
        if tape is not None:
            tape.append((t, state, zr, new, own[:, 2 * h :]))
        state = new + zr[:, :h] * (state - new)
        if inside is not None:
            state *= inside[t][:, None]
        out[t] = state
    return out


def probabilities(p: dict, text: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """Of each language at each byte: (time, class, lane). Both directions step together, and lanes lie along
    the last axis, where numpy is fast: rows are update, reset and new gates, each forwards and backwards."""
    steps, lanes = text.shape
    h = HIDDEN
    x = [np.ascontiguousarray(p["x"][k % 2][:, k // 2 * h : (k // 2 + 1) * h].T) for k in range(6)]
    u = np.zeros((6 * h, 2 * h), np.float32)
    for k in range(6):
        u[k * h : (k + 1) * h, k % 2 * h : (k % 2 + 1) * h] = p["u"][k % 2][:, k // 2 * h : (k // 2 + 1) * h].T
    state, gates, own = (np.zeros((n * h, lanes), np.float32) for n in (2, 6, 6))
    zr, new, both = gates[: 4 * h], gates[4 * h :], np.empty((steps, 2 * h, lanes), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        for k in range(6):
            np.take(x[k], text[back if k % 2 else t], axis=1, out=gates[k * h : (k + 1) * h], mode="clip")
        np.matmul(u, state, out=own)
        zr += own[: 4 * h]
        _sigmoid(zr)
        own[4 * h :] *= zr[2 * h :]
        new += own[4 * h :]
        new *= 2
        _sigmoid(new)  # tanh(x) = 2 sigmoid(2 x) - 1
        new *= 2
        new -= 1
        state -= new
        state *= zr[: 2 * h]
        state += new
        if inside is not None:
            state[:h] *= inside[t]
            state[h:] *= inside[back]
        both[t, :h], both[back, h:] = state[:h], state[h:]
    prob = np.matmul(p["v"].T, both)
    prob += p["c"][:, None]
    prob -= prob.max(1, keepdims=True)
    np.exp(prob, out=prob)
    prob /= prob.sum(1, keepdims=True)
    return prob


def gradients(p: dict, text: np.ndarray, label: np.ndarray, inside: np.ndarray) -> tuple[float, dict]:
    """Cross entropy at every byte that a lane has, and its gradients by backpropagation through time."""
    h, tapes, counted = HIDDEN, ([], []), inside.ravel()
    both = np.concatenate([states(p, s, text, inside, tapes[s]) for s in (0, 1)], axis=2)
    flat = both.reshape(-1, 2 * h)
    logits = flat @ p["v"] + p["c"]
    logits -= logits.max(1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(1, keepdims=True)
    at = np.tile(label, len(text))
    loss = -(np.log(np.maximum(prob[np.arange(len(at)), at], 1e-9)) * counted).sum() / counted.sum()
    prob[np.arange(len(at)), at] -= 1
    prob *= (counted / counted.sum())[:, None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["v"], grad["c"] = flat.T @ prob, prob.sum(0)
    back = (prob @ p["v"].T).reshape(both.shape)
    for side in (0, 1):
        u, later = p["u"][side], np.zeros((text.shape[1], h), np.float32)
        for t, state, zr, new, own in reversed(tapes[side]):
            d = (later + back[t, :, side * h : (side + 1) * h]) * inside[t][:, None]
            z, r = zr[:, :h], zr[:, h:]
            d_new = d * (1 - z) * (1 - new * new)
            d_gate = np.concatenate([d * (state - new) * z * (1 - z), d_new * own * r * (1 - r), d_new], axis=1)
            np.add.at(grad["x"][side], text[t], d_gate)
            d_gate[:, 2 * h :] *= r
            grad["u"][side] += state.T @ d_gate
            later = d * z + d_gate @ u.T
    return float(loss), grad


def train(texts: list[bytes], labels: np.ndarray, classes: int, seed: int = 42) -> dict[str, np.ndarray]:
    """Adam on LENGTH bytes from random places, every language as often as the others; shorter texts are padded
    and the padding is masked. Texts may not be empty."""
    p, rng = start(classes, seed), np.random.default_rng(seed)
    by_class = [np.flatnonzero(labels == k) for k in range(classes)]
    by_class = [x for x in by_class if len(x)]
    if len(by_class) < 2:  # one language has all probability whatever the weights
        return p
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        rows = [rng.choice(by_class[i % len(by_class)]) for i in range(BATCH)]
        at = [int(rng.integers(0, max(1, len(texts[i]) - LENGTH + 1))) for i in rows]
        cut = [texts[i][a : a + LENGTH] for i, a in zip(rows, at, strict=True)]
        text = np.stack([np.frombuffer(x.ljust(LENGTH, b" "), np.uint8) for x in cut], axis=1)
        inside = (np.arange(LENGTH)[:, None] < [len(x) for x in cut]).astype(np.float32)
        _, grad = gradients(p, text, labels[rows], inside)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1))) * min(1.0, 1.0 / max(size, 1e-9))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def pooled(p: dict, texts: list[bytes], segment: int = SEGMENT, overlap: int = OVERLAP) -> np.ndarray:
    """Mean probability of each language over all bytes of each text.

    Every byte counts once, in its own segment; a segment also reads `overlap` bytes on either side, which
    settle the states of the two directions. A text of at most `segment` bytes is read from end to end."""
    total = np.zeros((len(texts), len(p["c"])))
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    cut = [
        (d, max(s, a - overlap), min(a + segment + overlap, e), a, min(a + segment, e))
        for d, (s, e) in enumerate(pairwise([0, *ends])) for a in range(s, e, segment)
    ]
    cut.sort(key=lambda c: c[1] - c[2])
    k = 0
    while k < len(cut):
        lanes = max(32, CELLS // (cut[k][2] - cut[k][1]))
        doc, first, last, own, end = np.array(cut[k : k + lanes]).T
        k += lanes
        at = first[None, :] + np.arange(int((last - first).max()))[:, None]
        inside = None if (last - first == len(at)).all() else (at < last).astype(np.float32)
        prob = probabilities(p, whole[np.minimum(at, len(whole) - 1)], inside)
        prob *= ((at >= own) & (at < end))[:, None, :]
        np.add.at(total, doc, prob.sum(0).T)
    return total / np.maximum([[len(t)] for t in texts], 1)


def _once(batches):
    """Rows (h, lang, t), each h once a task."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for h in batch.column("h").to_pylist():
            new.append(h not in seen)
            seen.add(h)
        yield batch.filter(pa.array(new, pa.bool_()))


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], dict]:
    """Learn from labelled rows (text, lang). Of each language at most rows_per_lang different texts, those with
    the lowest hashes, are gathered whole; of repeated rows one. Null and empty texts and null languages teach
    nothing; no usable row gives no language."""
    rows = docs.where("lang is not null and length(text) > 0").select("text", F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    known = staged(rows.select("lang", "h").distinct(), "labelled")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], start(1)
    # texts are different, so their hashes are spread evenly and few more than wanted come back
    share = {n: min(1.0, (rows_per_lang + 6 * rows_per_lang**0.5) / counts[n]) for n in langs}
    low = F.create_map(*[F.lit(x) for n in langs for x in (n, share[n] * 2.0**64 - 2.0**63)])
    by_lang: dict[str, list[int]] = {n: [] for n in langs}
    for r in known.where(F.col("h").cast("double") <= low[F.col("lang")]).collect():
        by_lang[r.lang].append(r.h)
    forget(known)
    chosen = [h for hashes in by_lang.values() for h in sorted(hashes)[:rows_per_lang]]
    sample = rows.where(F.col("h").isin(chosen)).select("h", "lang", F.col("text").alias("t"))
    sample = sample.mapInArrow(_once, "h bigint, lang string, t string").dropDuplicates(["h"])
    got = sorted((r.lang, r.t) for r in sample.collect())
    labels = np.array([langs.index(n) for n, _ in got], dtype=np.int64)
    return langs, train([t.encode() for _, t in got], labels, len(langs))


def label_language(docs: DataFrame, model: tuple[list[str], dict], name: str = "language") -> DataFrame:
    """docs with a column struct<lang, score>: the language and its mean probability over all bytes.

    A null text, a text without a letter (\\p{L}), or a model that has learned no language gives lang `und`
    and score 0. Other columns stay as they are."""
    langs, params = model
    blob = docs.sparkSession.sparkContext.broadcast(params)

    @F.arrow_udf("struct<lang:string, score:double>")
    def tag(texts: pa.Array, has_letter: pa.Array) -> pa.Array:
        known = has_letter.to_pylist()
        own = [t if ok and langs else b"" for t, ok in zip(texts.cast(pa.binary()).to_pylist(), known, strict=True)]
        p = pooled(blob.value, own) if langs else np.zeros((len(own), 1))
        best = p.argmax(1)
        names = [langs[b] if t else UNKNOWN for b, t in zip(best, own, strict=True)]
        scores = np.clip(np.where([bool(t) for t in own], p[np.arange(len(own)), best], 0.0), 0, 1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    return docs.withColumn(name, tag(F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = crc_mod(F.col("doc_id"), 4)
    model = fit(docs.where(rest != 2))
    out = label_language(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(rest == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
