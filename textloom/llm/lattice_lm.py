"""Likelihood of texts by the lattice of all their segmentations into the pieces of an existing vocabulary.

A text is a sequence of words and an end; a word is a space and its bytes, made
from pieces that each occur with a probability of their own. Pieces hold a space
only in front, so the sum over a text's segmentations is the product of the sums
over its words', and these are found once for each distinct word: a forward
recursion in log space over its bytes. Every single byte is a piece too, so no
text is impossible.

The vocabulary is never trained; its file's scores are where the pieces'
probabilities start. If these are ranks of merges and no probabilities, as in a
BPE file, they stand for a Zipf law. ROUNDS rounds of expectation and maximisation
over the distinct training words with their counts then fit them, by backward
recursions on the same lattices.

Distinct words with counts come from all documents and stay in Spark. The scores
of the HEAD commonest words go to all tasks, which sum them by document; only the
tokens of rarer words are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SpanHasher, forget, materialise, spread_join

#: Commonest words whose scores go to all tasks: 8 MB at the worst for words of usual length, longer than LONGEST not among them.
HEAD, LONGEST = 65_536, 64
#: Distinct words that a task counts before it passes them on, and bytes of text that it splits at once.
HELD, PART = 400_000, 1 << 22
#: Cells (word, byte) of lattices that are worked on at once.
CELLS = 1 << 16
ROUNDS, SMOOTH = 2, 0.1
hasher = SpanHasher()


def read_vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(piece with a space for the word mark, starting weight) of a sentencepiece file.

    Control pieces, those with a mark elsewhere than in front, and those with A-Z,
    which lower-cased texts never hold, are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in usable]
    ranks = all(float(s).is_integer() for s in scores)
    out = []
    for i, s in zip(usable, scores, strict=True):
        piece = model.id_to_piece(i).encode().replace("▁".encode(), b" ")
        if b" " not in piece[1:] and piece.lower() == piece:
            out.append((piece, 1.0 / (1.0 - s) if ranks else float(np.exp(s))))
    return out


class Lattice:
    """Pieces and their log probabilities (natural)."""

    def __init__(self, vocabulary: list[tuple[bytes, float]]) -> None:
        weights = dict(vocabulary)
        least = min(weights.values(), default=1.0)
        for b in range(256):
            if b == 32 or not 9 <= b <= 13:  # the other spaces separate words
                weights.setdefault(bytes([b]), least)
        self.pieces = sorted(weights)
        self.log = np.log(np.array([weights[p] for p in self.pieces]) / sum(weights.values()))
        sizes = np.array([len(p) for p in self.pieces])
        self.sizes = np.unique(sizes).tolist()
        self.tables = []
        for n in self.sizes:
            which = np.flatnonzero(sizes == n)
            data = np.frombuffer(b"".join(self.pieces[i] for i in which), np.uint8)
            at = np.arange(len(which)) * n
            key = hasher.spans(hasher.prefix(data), at, at + n)
            order = np.argsort(key)
            seen = np.zeros(1 << 16, bool)
            seen[key & np.uint64(0xFFFF)] = True
            self.tables.append((n, key[order], which[order], seen))

    def edges(self, data: np.ndarray, first: int, last: int) -> np.ndarray:
        """Piece (or -1) of each size that ends after byte first..last-1 of each row: (rows, last - first, sizes)."""
        low = max(0, first - self.sizes[-1])
        part = np.ascontiguousarray(data[:, low:last])
        rows, width = part.shape
        prefix = hasher.prefix(part.ravel())
        out = np.full((rows, last - first, len(self.sizes)), -1, np.int32)
        for k, (n, keys, which, seen) in enumerate(self.tables):
            start = max(n, first - low + 1)  # the end's place in the part
            if start > width:
                break
            ends = (np.arange(rows)[:, None] * width + np.arange(start, width + 1)).ravel()
            found = hasher.spans(prefix, ends - n, ends)
            maybe = np.flatnonzero(seen[found & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(keys, found[maybe]), len(keys) - 1)
            same = keys[place] == found[maybe]
            hit = np.full(len(ends), -1, np.int32)
            hit[maybe[same]] = which[place[same]]
            out[:, start - (first - low) - 1 :, k] = hit.reshape(rows, -1)
        return out

    def weights(self, edges: np.ndarray) -> np.ndarray:
        return np.where(edges >= 0, self.log[edges], -np.inf)

    def forward(self, data: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations of each row's first 0, 1, 2... bytes."""
        rows, width = data.shape
        alpha = np.full((rows, width + 1), -np.inf)
        alpha[:, 0] = 0.0
        step = max(64, CELLS // rows)
        for first in range(0, width, step):
            log = self.weights(self.edges(data, first, min(width, first + step)))
            for t in range(first + 1, min(width, first + step) + 1):
                usable = [k for k, n in enumerate(self.sizes) if n <= t]
                alpha[:, t] = log_sum(alpha[:, [t - self.sizes[k] for k in usable]] + log[:, t - first - 1, usable])
        return alpha

    def expected(self, data: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the rows' first `lengths` bytes, each taken `counts` times."""
        rows, width = data.shape
        alpha = self.forward(data)
        total = alpha[np.arange(rows), lengths]
        beta = np.full((rows, width + 1), -np.inf)
        beta[np.arange(rows), lengths] = 0.0
        out = np.zeros(len(self.pieces))
        step = max(64, CELLS // rows)
        for first in reversed(range(0, width, step)):
            edges = self.edges(data, first, min(width, first + step))
            log = self.weights(edges)
            for t in range(min(width, first + step), first, -1):
                for k, n in enumerate(self.sizes):
                    if n <= t:
                        via = log[:, t - first - 1, k] + beta[:, t]
                        if np.isfinite(via).any():
                            beta[:, t - n] = np.logaddexp(beta[:, t - n], via)
                            share = np.exp(alpha[:, t - n] + via - total)
                            used = share > 0
                            out += np.bincount(edges[used, t - first - 1, k], share[used] * counts[used], len(out))
        return out

    def fitted(self, counts: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
        """Smoothed log probabilities of the pieces and of the end."""
        total = counts.sum() + ends + SMOOTH * (len(counts) + 1)
        return np.log((counts + SMOOTH) / total), float(np.log((ends + SMOOTH) / total))


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[:, None]).sum(1)) + safe


def lattices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their bytes after a space in rows of one width, lengths): words of like length, CELLS at once or one word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] * (end + 1 - at) <= CELLS:
            end += 1
        which = order[at:end]
        width = int(sizes[which[-1]])
        data = np.frombuffer(b"".join((b" " + words[i]).ljust(width, b"\0") for i in which.tolist()), np.uint8).reshape(len(which), width)
        yield which, data, sizes[which]
        at = end


def tokens(texts: list[str | None]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(index of the first text, words of some texts, words of each text), PART bytes at a time; A-Z lower-cased."""
    at = 0
    while at < len(texts):
        flat, sizes, used, first = [], [], 0, at
        while at < len(texts) and (used < PART or at == first):
            found = (texts[at] or "").encode("utf-8", "replace").lower().split()
            flat += found
            sizes.append(len(found))
            used += len(texts[at] or "")
            at += 1
        yield first, flat, np.array(sizes, np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c: times in training texts, held: in the others) of every distinct word; the end is the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()  # training, held out
        ends = [0, 0]

        def flush() -> pa.RecordBatch:
            words = [*seen[0], *seen[1]]
            train = [*seen[0].values(), *repeat(0, len(seen[1]))]
            held = [*repeat(0, len(seen[0])), *seen[1].values()]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(train, pa.int64()), pa.array(held, pa.int64())], ["word", "c", "held"])

        for batch in batches:
            out = batch.column("held_out").to_pylist()
            for first, flat, sizes in tokens(batch.column("text").to_pylist()):
                at = 0
                for k, n in enumerate(sizes.tolist()):
                    side = out[first + k]
                    seen[side].update(flat[at : at + n])
                    ends[side] += 1
                    at += n
                    if len(seen[0]) + len(seen[1]) > HELD:
                        yield flush()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array(ends[:1]), pa.array(ends[1:])], ["word", "c", "held"])

    found = docs.select("held_out", "text").mapInArrow(run, "word string, c long, held long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def expected_counts(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected uses of each piece over all training words: one vector a partition, merged in a tree."""
    sent = words.sparkSession.sparkContext.broadcast(lattice)  # the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = sent.value, np.zeros(len(sent.value.pieces))
        for batch in batches:
            found, counts = batch.column("word").cast(pa.binary()).to_pylist(), batch.column("c").to_numpy()
            for which, data, lengths in lattices(found):
                total += here.expected(data, lengths, counts[which].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = words.filter("word IS NOT NULL AND c > 0").select("word", "c").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0]))
    none = words.sparkSession.sparkContext.parallelize([np.zeros(len(lattice.pieces))], 1)
    return vectors.union(none).treeReduce(np.add, depth=2)


def score_words(words: DataFrame, lattice: Lattice, all_: int, distinct: int) -> DataFrame:
    """(word, n: times in all texts, known, base, score) of each word, in log10."""
    sent = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, c, held = batch.column("word").cast(pa.binary()).to_pylist(), batch.column("c").to_numpy(), batch.column("held").to_numpy()
            score = np.zeros(len(found))
            for which, data, lengths in lattices(found):
                score[which] = sent.value.forward(data)[np.arange(len(which)), lengths] / np.log(10)
            cols = [batch.column("word"), pa.array(c + held), pa.array((c > 0).astype(np.int64)), pa.array(base(c, all_, distinct)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["word", "n", "known", "base", "score"])

    return words.filter("word IS NOT NULL").mapInArrow(run, "word string, n long, known long, base double, score double")


def base(c: np.ndarray, all_: int, distinct: int) -> np.ndarray:
    return np.log10((c + 0.1) / (all_ + 0.1 * (distinct + 1)))


def sum_head(docs: DataFrame, head: pa.Table) -> DataFrame:
    """(id, held_out, n_tokens, sums of known, base and score over the words of head, rest: the other words) of each row, without the end."""
    table = {w: k for k, w in enumerate(head.column("word").cast(pa.binary()).to_pylist())}
    values = [np.r_[head.column(c).to_numpy(), 0.0] for c in ("known", "base", "score")]  # the last one for words not there
    sent = docs.sparkSession.sparkContext.broadcast((table, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, values = sent.value
        for batch in batches:
            for first, flat, sizes in tokens(batch.column("text").to_pylist()):
                rows = np.repeat(np.arange(len(sizes)), sizes)
                place = np.fromiter(map(table.get, flat, repeat(-1)), np.int64, len(flat))
                sums = [np.bincount(rows, v[place], len(sizes)) for v in values]
                other = np.flatnonzero(place < 0)
                offsets = np.r_[0, np.cumsum(np.bincount(rows[other], minlength=len(sizes)))].astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array([flat[i] for i in other.tolist()], pa.binary()).cast(pa.string()))
                part = batch.slice(first, len(sizes))
                cols = [part.column("id"), part.column("held_out"), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rest]
                yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "known", "base", "score", "rest"])

    return docs.mapInArrow(run, "id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<string>")


def score_texts(docs: DataFrame, vocabulary: list[tuple[bytes, float]], folds: int = 10, held_fold: int = 0, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out: the crc32 of the id as text leaves held_fold modulo `folds`; these
    rows teach nothing. A null id counts as held out. A null or empty text has the
    end only. Repeated rows count each. Without training rows nothing is known and
    the pieces are all equally probable. No documents give no rows. Only the two
    named columns are read.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % folds == held_fold, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    words = materialise(count_words(rows), "words")
    ends = words.filter("word IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    all_, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()

    lattice = Lattice(vocabulary)
    counts = np.zeros(len(lattice.pieces))
    for _ in range(rounds):
        counts = expected_counts(words, lattice)
        lattice.log, end = lattice.fitted(counts, ends)
    lattice.log, end = lattice.fitted(counts, ends)

    scored = materialise(score_words(words, lattice, all_, distinct), "scored")
    forget(words)
    head = scored.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    summed = materialise(sum_head(rows, head).withColumn("row", F.monotonically_increasing_id()), "summed")
    rare = F.lit(True)
    if head.num_rows:
        last = head.slice(head.num_rows - 1).to_pylist()[0]
        rare = (F.octet_length("word") > LONGEST) | (F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"]))
    rest = summed.select("row", F.explode("rest").alias("word"))
    late = spread_join(rest, scored.filter(rare), ["word"], "n", ["row"]).groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    end_base = float(base(np.array(ends), all_, distinct))
    return summed.drop("rest").join(late, "row", "left").select(
        F.col("id").alias(id_col), "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("known") + zero("k") + int(ends > 0)).alias("n_known"), F.lit(all_).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + end_base).alias("base_score"), (F.col("score") + zero("s") + end / float(np.log(10))).alias("score"),
    )
