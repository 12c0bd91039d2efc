"""Language of texts by a linear-chain conditional random field over words.

Each word's emission is a sum of learned weights of hashed features: all its
1- to 4-grams of bytes, its prefixes and suffixes (affixes), and the word itself
(lexicon). Learned transitions join the words; forward-backward gives every word
its distribution over languages, so a switch inside a text is seen, and the
text's language is the one with the largest mean. Training sequences mix
stretches of different languages so that the transitions learn switching.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import SpanHasher, give_back

SLOTS = 1 << 16
SEGMENT = 32
LETTER = regex.compile(r"\p{L}")
#: What lies between words besides the ASCII characters that are no letters.
BETWEEN = regex.compile(r"[^\x00-\x7F\p{L}\p{M}]+")
IS_LETTER = np.zeros(256, bool)
IS_LETTER[np.r_[65:91, 97:123, 128:256]] = True
hasher = SpanHasher()


class Words:
    """The words of some texts: distinct ones with their features, and where each occurs."""

    def __init__(self, texts: list[str]) -> None:
        raw = [(t if t.isascii() else BETWEEN.sub(" ", t)).lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        inside = IS_LETTER[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        self.prefix = hasher.prefix(data)
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        self.counts = np.diff(np.r_[0, np.searchsorted(starts, text_ends, "right")])  # words of each text
        _, first, self.word = np.unique(hasher.spans(self.prefix, starts, ends), return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of distinct word, slot) of every feature."""
        owners, slots = [], []
        size = self.ends - self.starts
        every = np.arange(len(size))

        def add(kind: int, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            owners.append(owner)
            slots.append(((hasher.spans(self.prefix, start, end) ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(SLOTS)).astype(np.int64))

        for n in (1, 2, 3, 4):
            many = np.maximum(size - n + 1, 0)
            owner = np.repeat(every, many)
            start = self.starts[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            add(1, owner, start, start + n)
            has = np.flatnonzero(size >= n)
            if n < 4:
                add(2, has, self.starts[has], self.starts[has] + n)
                add(3, has, self.ends[has] - n, self.ends[has])
        add(4, every, self.starts, self.ends)
        return np.concatenate(owners), np.concatenate(slots)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Score of each distinct word for each language."""
        owner, slot = self.features()
        return np.stack([np.bincount(owner, weights[slot, k], len(self.starts)) for k in range(weights.shape[1])], 1)


def marginals(score: np.ndarray, counts: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Forward-backward over texts of `counts` words each; score: (all words, languages).

    Exact: texts are cut into segments whose transfer matrices are multiplied
    first, so that all segments of all texts step together. Before a text's first
    word stands a state of no known language (all alike), joined to it by the
    transitions too. With `pairs`, also the expected number of each transition,
    and for each word the beliefs about the state before it.
    """
    n_words, n_lang = score.shape
    p = (np.exp(score - score.max(1, keepdims=True, initial=-1e9)) + 1e-9).astype(np.float32)
    per = -(-counts // SEGMENT)
    n_seg = int(per.sum())
    seg_first = np.cumsum(per) - per
    word_text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n_words) - np.repeat(np.cumsum(counts) - counts, counts)
    row, col = seg_first[word_text] + place // SEGMENT, place % SEGMENT
    grid = np.ones((n_seg, SEGMENT, n_lang), np.float32)
    used = np.zeros((n_seg, SEGMENT, 1), bool)
    grid[row, col], used[row, col] = p, True
    move = np.exp(transition - transition.max()).astype(np.float32)

    transfer = np.broadcast_to(np.eye(n_lang, dtype=np.float32), (n_seg, n_lang, n_lang)).copy()
    for t in range(SEGMENT):
        step = (transfer.reshape(-1, n_lang) @ move).reshape(transfer.shape) * grid[:, t, None, :]
        step /= step.max((1, 2), keepdims=True)
        transfer = np.where(used[:, t, :, None], step, transfer)
    enter, leave = np.full((n_seg, n_lang), 1 / n_lang, np.float32), np.full((n_seg, n_lang), 1 / n_lang, np.float32)
    for k in range(1, int(per.max(initial=0))):
        at = seg_first[per > k] + k
        v = np.einsum("di,dij->dj", enter[at - 1], transfer[at - 1])
        enter[at] = v / v.sum(1, keepdims=True)
    for k in range(int(per.max(initial=0)) - 2, -1, -1):
        at = seg_first[per > k + 1] + k
        v = np.einsum("dij,dj->di", transfer[at + 1], leave[at + 1])
        leave[at] = v / v.sum(1, keepdims=True)
    ahead = np.empty_like(grid)
    earlier, later = (np.empty_like(grid) for _ in range(2)) if pairs else (ahead, ahead)
    state = enter
    for t in range(SEGMENT):
        step = (state @ move) * grid[:, t]
        if pairs:
            earlier[:, t] = state
        state = np.where(used[:, t], step / step.sum(1, keepdims=True), state)
        ahead[:, t] = state
    state = leave
    for t in range(SEGMENT - 1, -1, -1):
        ahead[:, t] *= state
        if pairs:
            later[:, t] = grid[:, t] * state
        step = (grid[:, t] * state) @ move.T
        state = np.where(used[:, t], step / step.sum(1, keepdims=True), state)
    out = ahead[row, col]
    out /= out.sum(1, keepdims=True)
    if not pairs:
        return out
    joint = earlier[row, col][:, :, None] * move * later[row, col][:, None, :]  # p(state before, state) of each word
    return out, joint / joint.sum((1, 2), keepdims=True)


def gradients(score: np.ndarray, label: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of minus the log-likelihood of the labels: by each word's scores, and by the transitions."""
    n_lang = len(transition)
    belief, joint = marginals(score, counts, transition, pairs=True)
    first = np.zeros(len(label), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    seen = np.zeros((n_lang, n_lang))
    after = np.flatnonzero(~first)
    np.add.at(seen, (label[after - 1], label[after]), 1.0)
    reach = np.exp(transition - transition.max(0))
    np.add.at(seen.T, label[first], (reach / reach.sum(0)).T[label[first]])  # from the state before a text
    return belief - np.eye(n_lang)[label], joint.sum(0, dtype=np.float64) - seen


def fit(texts: list[str], langs: list[str], window: int = 160, span: int = 64, rounds: int = 30, seed: int = 7) -> dict:
    """Weights and transitions by Adam on the likelihood of mixed sequences of `span` words.

    Of each text at most `window` words are used, from a random place. No text
    with words gives a model that knows no language.
    """
    names = sorted(set(langs))
    words = Words(texts)
    if not names or not len(words.word):
        return {"names": [], "weights": None, "transition": None}
    rng = np.random.default_rng(seed)
    first = np.cumsum(words.counts) - words.counts
    pieces = []  # (language, words), stretches of 8 to 48 words
    for at, n, lang in zip(first.tolist(), words.counts.tolist(), langs, strict=True):
        at, n = at + (int(rng.integers(0, n - window)) if n > window else 0), min(n, window)
        while n > 0:
            size = min(n, int(rng.integers(8, 49)))
            pieces.append((names.index(lang), words.word[at : at + size]))
            at, n = at + size, n - size
    rng.shuffle(pieces)
    word = np.concatenate([w for _, w in pieces])
    label = np.concatenate([np.full(len(w), k) for k, w in pieces])
    counts = np.r_[np.full(len(word) // span, span), len(word) % span].astype(np.int64)
    counts = counts[counts > 0]
    n_lang = len(names)
    owner, slot = words.features()
    weights, transition = np.zeros((SLOTS, n_lang)), np.zeros((n_lang, n_lang))
    moments = [np.zeros_like(x) for x in (weights, weights, transition, transition)]
    for k in range(1, rounds + 1):
        score = np.stack([np.bincount(owner, weights[slot, i], len(words.starts)) for i in range(n_lang)], 1)[word]
        by_place, by_move = gradients(score, label, counts, transition)
        by_word = np.stack([np.bincount(word, by_place[:, i], len(words.starts)) for i in range(n_lang)], 1)
        grad = np.stack([np.bincount(slot, by_word[owner, i], SLOTS) for i in range(n_lang)], 1) / len(word) + 1e-7 * weights
        steps = (grad, by_move / len(word))
        for x, g, m, v in zip((weights, transition), steps, (moments[0], moments[2]), (moments[1], moments[3]), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return {"names": names, "weights": weights.astype(np.float32), "transition": transition}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Language and mean belief of each whole text; `und` and 0 without a letter or a model.

    Of languages with equal beliefs the first by name is taken.
    """
    names = model["names"]
    has = [k for k, t in enumerate(texts) if t and names and LETTER.search(t)]
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    if has:
        words = Words([texts[k] for k in has])
        belief = marginals(words.emissions(model["weights"])[words.word], words.counts, model["transition"])
        owner = np.repeat(np.arange(len(has)), words.counts)
        mean = np.stack([np.bincount(owner, belief[:, i], len(has)) for i in range(len(names))], 1) / np.maximum(words.counts, 1)[:, None]
        for k, best, row in zip(has, mean.argmax(1).tolist(), mean, strict=True):
            out[k], score[k] = names[best], min(1.0, float(row[best]))
    return out, score


def held_out(id_col: str) -> Column:
    """crc32(id as text) mod 4 is 2: rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 250, window: int = 160) -> dict:
    """Fits on a bounded sample: about rows_per_lang labelled rows of each language, never held-out ones, at most `window` words of each from a random place."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    base = base.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    counts = {r[0]: r[1] for r in base.groupBy("lang").count().collect()}
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, float(rows_per_lang) / n)]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    some = base.filter(chance < F.element_at(rate, F.col("lang"))).withColumn("words", F.split("text", r"\s+"))
    place = F.pmod(F.xxhash64("id", F.lit(6)), F.greatest(F.size("words") - window + 1, F.lit(1))).cast("int") + 1
    rows = some.select("id", F.array_join(F.slice("words", place, window), " ").alias("text"), "lang").collect()
    rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["lang"], r["id"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], window)


def identify(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 250, carry: bool = False) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score; with `carry`, the columns of docs, then lang_pred and score.

    Null, empty and letterless texts are `und` with score 0; so is every text if
    no row has a language to learn. A letter is what Unicode calls one (category
    L). Repeated rows are judged alike. Predictions read whole texts and nothing else.
    """
    model = model or train(docs, id_col, text_col, lang_col, rows_per_lang)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def judged(texts: list[str | None]) -> dict[str, object]:
        from textloom.llm.tokens import batches

        langs, scores = [], [np.zeros(0)]
        for some in batches(texts, 1_500_000):
            lang, score = predict(some, shipped.value)
            langs += lang
            scores.append(score)
        return {"lang_pred": langs, "score": np.concatenate(scores)}

    if carry:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = judged(batch.column(batch.schema.names.index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found["lang_pred"], pa.string()), pa.array(found["score"], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
            give_back()

        kinds = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        return docs.mapInArrow(run, kinds)

    def run_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "held_out": frame["held_out"], **judged(frame["text"].tolist())})
        give_back()

    base = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(base.dtypes)["id"]
    return base.mapInPandas(run_ids, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
