"""TF-IDF and logistic-regression baselines on Spark and Spark ML."""

from __future__ import annotations

import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions import text as tx


def places(size: Column, n: int) -> Column:
    """Starts of the n-long runs in `size` elements; none if there are fewer."""
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))


def word_ngrams(c: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """Space-joined n-grams of white-space words."""

    def of(w: Column, n: int) -> Column:
        return F.transform(places(F.size(w), n), lambda i: F.array_join(F.slice(w, i, n), " "))

    return tx.let(tx.words(c), lambda w: F.concat(*[w if n == 1 else of(w, n) for n in sizes]))


def char_ngrams(c: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words that are padded with a space on both sides."""

    def of(padded: Column, n: int) -> Column:
        return F.transform(places(F.length(padded), n), lambda i: F.substring(padded, i, F.lit(n)))

    return F.flatten(F.transform(tx.words(c), lambda word: tx.let(F.concat(F.lit(" "), word, F.lit(" ")), lambda p: F.concat(*[of(p, n) for n in range(low, high + 1)]))))


def term_counts(df: DataFrame, id_col: str, text: str, ngrams: tuple[int, ...] = (1, 2), chars: bool = False) -> DataFrame:
    """(id, term, tf) of word n-grams, or of character n-grams inside words, `ngrams` giving their least and largest length."""
    terms = char_ngrams(F.col(text), min(ngrams), max(ngrams)) if chars else word_ngrams(F.col(text), ngrams)
    return df.select(id_col, F.explode(terms).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def vocabulary(train: DataFrame, id_col: str, text: str, ngrams: tuple[int, ...] = (1, 2), min_df: int = 2, chars: bool = False, max_features: int | None = None) -> DataFrame:
    """(term, idf) of the terms in at least min_df rows, the max_features most frequent of them (of equal ones the first by name).

    Texts go to their row's partition before they are cut up, so that only counts by term are shuffled after that.
    """
    known = term_counts(train.select(id_col, text).repartition(id_col), id_col, text, ngrams, chars).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).filter(F.col("df") >= min_df)
    if max_features:
        known = known.orderBy(F.desc("all"), "term").limit(max_features)
    return known.select("term", (F.ln((1 + F.lit(train.count())) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(df: DataFrame, id_col: str, text: str, known: DataFrame, ngrams: tuple[int, ...] = (1, 2), chars: bool = False) -> DataFrame:
    """(id, term, weight, and what else `known` has): sublinear tf times idf, L2-normalised per row; rows without a known term have none."""
    more = [c for c in known.columns if c not in ("term", "idf")]
    rows = term_counts(df.select(id_col, text).repartition(id_col), id_col, text, ngrams, chars).join(known, "term").select(id_col, "term", *more, ((1 + F.ln("tf")) * F.col("idf")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(id_col)))
    return rows.select(id_col, "term", *more, (F.col("v") / norm).alias("weight"))


def tfidf(df: DataFrame, id_col: str, text: str, ngrams: tuple[int, ...] = (1, 2), min_df: int = 2, chars: bool = False, max_features: int | None = None) -> DataFrame:
    """(id, term, weight): sublinear tf times smoothed idf, L2-normalised per row."""
    return weigh(df, id_col, text, vocabulary(df, id_col, text, ngrams, min_df, chars, max_features), ngrams, chars)


#: The two kinds of terms, as (lengths, in how many rows at least, of characters).
TERM_KINDS = {"word_1_2": ((1, 2), 2, False), "char_2_5": ((2, 5), 3, True)}
MAX_FEATURES = 300_000


#: Distinct terms that a task counts before it hands them on, entries of vectors that lie in one block, and entries that a task counts at once.
COUNTED, BLOCK, AT_ONCE = 250_000, 500_000, 2_000_000


def terms_of(text: str | None, ngrams: tuple[int, ...], chars: bool) -> Counter:
    """Counts of the terms of one text, those of word_ngrams and char_ngrams; null as empty. str.split() takes for white space what functions/text.py does."""
    w, found = (text or "").split(), Counter()
    if not chars:
        for n in ngrams:
            found.update(w if n == 1 else map(" ".join, zip(*(w[k:] for k in range(n)), strict=False)))
        return found
    for word, k in Counter(w).items():
        for gram in grams_of(word, ngrams):
            found[gram] = found.get(gram, 0) + k
    return found


def grams_of(word: str, ngrams: tuple[int, ...]) -> list[str]:
    """The character n-grams of one word, those of char_ngrams."""
    padded = f" {word} "
    return [padded[i : i + n] for n in range(min(ngrams), max(ngrams) + 1) for i in range(len(padded) - n + 1)]


def packing(ngrams: tuple[int, ...]) -> tuple[int, re.Pattern]:
    """Bits for one character, so that the longest n-gram has room in 63, and what finds a character that doesn't fit (any, if the space doesn't)."""
    bits = min(63 // max(ngrams), 20)
    return bits, re.compile(f"[^\x01-{chr((1 << bits) - 1)}]" if bits > 5 else "")


def key_of(gram: str, bits: int) -> int:
    """The codes of the characters side by side."""
    key = 0
    for c in gram:
        key = key << bits | ord(c)
    return key


def gram_of(key: int, bits: int) -> str:
    """The n-gram of key_of()."""
    found = ""
    while key:
        found, key = chr(key & (1 << bits) - 1) + found, key >> bits
    return found


def keyed(odd, ngrams: tuple[int, ...], chars: bool):
    """A function that gives the distinct keys of a text's terms, and how often each is there, as terms_of() counts.

    Character n-grams have key_of() as their key where all characters fit. All other terms have what `odd` gives, a key below 0, or None to leave one out.
    """
    bits, wide = packing(ngrams)
    low, high = min(ngrams), max(ngrams)

    def of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if not chars:
            found = [(k, n) for t, n in terms_of(text, ngrams, chars).items() if (k := odd(t)) is not None]
            return tuple(np.array(found, np.int64).reshape(-1, 2).T)
        words, others = (text or "").split(), []
        if wide.search(" ".join(words)):
            for word in words:
                if wide.search(word):
                    others += [odd(g) if wide.search(g) else key_of(g, bits) for g in grams_of(word, ngrams)]
            words = [word for word in words if not wide.search(word)]
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le") if words else b"", "<u4").astype(np.int64)
        parts = [np.array([k for k in others if k is not None], np.int64)]
        if low == 1:
            parts += [codes[codes != 32], np.full(2 * len(words), 32)]
        key, inside, letter = codes, np.ones(len(codes), bool), codes != 32
        for n in range(2, high + 1):  # windows of n characters without a space between their ends
            key = (key[:-1] << bits) + codes[n - 1 :]
            inside = inside[:-1] if n == 2 else inside[:-1] & letter[n - 2 : -1]
            if n >= low:
                parts.append(key[inside])
        keys = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.diff(np.append(first, len(keys)))

    return of


def places_of(terms: list[str], ngrams: tuple[int, ...], chars: bool) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """For keyed(): sorted keys with the places of their terms (and a last one that no term has), and the keys of the other terms, -1 - place."""
    bits, wide = packing(ngrams)
    odd, keys = {}, []
    for k, t in enumerate(terms):
        if chars and not wide.search(t):
            keys.append((key_of(t, bits), k))
        else:
            odd[t] = -1 - k
    keys, at = np.array([*sorted(keys), (2**63 - 1, -1)], np.int64).T
    return keys.copy(), at.copy(), odd


def frequent_terms(train: DataFrame, n: int, ngrams: tuple[int, ...], min_df: int, chars: bool, max_features: int) -> DataFrame:
    """(term, idf) of the terms in at least min_df of the n rows of `text`, as vocabulary() has them, but every row is a text of its own.

    Tasks count terms over many texts before anything is shuffled.
    """

    def counted(batches):
        texts = (text.as_py() for batch in batches for text in batch.column(0))
        names: dict[str, int] = {}
        of = keyed(lambda term: names.setdefault(term, -1 - len(names)), ngrams, chars)
        bits, some, size = packing(ngrams)[0], [], 0

        def taken():
            """Sums by key of what was counted."""
            keys, dfs, alls = map(np.concatenate, zip(*some, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            return (keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (dfs, alls)))

        def as_batch(keys, dfs, alls):
            odd = list(names)
            terms = [odd[-1 - k] if k < 0 else gram_of(k, bits) for k in keys.tolist()]
            return pa.RecordBatch.from_pydict({"term": terms, "df": dfs, "all": alls})

        for text in texts:
            keys, tf = of(text)
            some.append((keys, np.ones(len(keys), np.int64), tf))
            size += len(keys) + 1
            if size >= AT_ONCE or len(names) >= COUNTED:
                some = [taken()]
                size = len(some[0][0])
                if size >= COUNTED:
                    yield as_batch(*some[0])
                    names.clear()
                    some, size = [], 0
        if some:
            yield as_batch(*taken())

    known = train.select("text").mapInArrow(counted, "term string, df long, all long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))
    known = known.filter(F.col("df") >= min_df).orderBy(F.desc("all"), "term").limit(max_features)
    return known.select("term", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(batches, known: tuple[tuple[np.ndarray, np.ndarray, dict[str, int]], np.ndarray], ngrams: tuple[int, ...], chars: bool):
    """(row, places, weights) for rows with a `text`: sublinear tf times idf, L2-normalised, then the constant 1 at the last place."""
    (keys, places, odd), idf = known
    of = keyed(odd.get, ngrams, chars)
    for batch in batches:
        for row, text in zip(batch.drop_columns(["text"]).to_pylist(), batch.column("text"), strict=True):
            found, tf = of(text.as_py())
            near = np.searchsorted(keys, found)
            at = np.where(found < 0, -1 - found, np.where(keys[near] == found, places[near], -1))
            at, tf = at[at >= 0], tf[at >= 0]
            v = (1 + np.log(tf)) * idf[at]
            yield row, np.append(at, len(idf)).astype(np.int32), np.append(v / (np.sqrt(v @ v) or 1.0), 1.0)


def record_batches(rows, schema: T.StructType, most: int = 200):
    """Rows (dicts) in Arrow batches of at most `most`."""
    arrow, rows = to_arrow_schema(schema), iter(rows)
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, arrow)


def in_blocks(rows):
    """(labels, sizes, places, weights) of rows of vectors, in blocks of about BLOCK entries."""
    some, size = [], 0

    def block():
        labels, ats, weights = zip(*some, strict=True)
        return np.array(labels, float), np.array([len(a) for a in ats]), np.concatenate(ats), np.concatenate(weights)

    for label, at, weight in rows:
        some.append((label, at, weight))
        size += len(at)
        if size >= BLOCK:
            yield block()
            some, size = [], 0
    if some:
        yield block()


def losses(blocks, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the logistic losses over all rows and its gradient, at each of the points."""
    loss, slope = np.zeros(len(points)), np.zeros(points.shape)
    for y, sizes, at, weight in blocks:
        starts, at, weight = np.cumsum(sizes) - sizes, at.astype(np.intp), weight.astype(float)  # else numpy turns them into that each time
        for k, w in enumerate(points):
            m = np.add.reduceat(w[at] * weight, starts)
            loss[k] += (np.logaddexp(0, m) - y * m).sum()
            slope[k] += np.bincount(at, np.repeat(1 / (1 + np.exp(-np.clip(m, -700, 700))) - y, sizes) * weight, len(w))
    return loss, slope


def descend(size: int, penalty: float, within: float = 1e-4, steps: int = 300, kept: int = 20, constant: float = 0.05):
    """L-BFGS from 0: yields points, is sent the loss (with the penalty of that strength) and its gradient there, and returns the point.

    The last feature, the constant, is in every row and outweighs each term, so steps along it are shorter by the factor `constant`; that
    changes the way, not the end. The loss exceeds its least by |gradient|^2 / (2 penalty) at most; it stops where that is at most `within` times the loss.
    """
    x, past, scale = np.zeros(size), [], np.ones(size)
    scale[-1] = constant
    f, g = yield x
    for _ in range(steps):
        if g @ g <= 2 * penalty * within * f:
            break
        d, used = -g, []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            d = d - a * y
            used.append(a)
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ (scale * y)))
        d = scale * d
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            d = d + (a - r * (y @ d)) * s
        slope, t = g @ d, 1.0
        while True:
            f_new, g_new = yield x + t * d
            if f_new <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = t * d, g_new - g
        x, f, g = x + s, f_new, g_new
        if s @ y <= 0:  # as near as doubles tell
            break
        past = [*past[1 - kept :], (s, y, 1 / (s @ y))]
    return x


def penalised(blocks, size: int, n: int, grid: tuple[float, ...]) -> np.ndarray:
    """Weights of L2 logistic regression on an RDD of blocks of n rows, for each strength; the intercept is penalised like the others.

    The strengths go down together: each job finds the losses at one point of every strength that isn't done.
    """
    runs = [descend(size, 1 / (c * n)) for c in grid]
    points, found = {k: next(run) for k, run in enumerate(runs)}, {}
    while points:
        shared = blocks.context.broadcast(np.array(list(points.values())))
        loss, slope = blocks.mapPartitions(lambda part, shared=shared: [losses(part, shared.value)]).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        shared.destroy()
        for (k, w), f, g in zip(list(points.items()), loss, slope, strict=True):
            penalty = 1 / (grid[k] * n)
            try:
                points[k] = runs[k].send((f / n + penalty / 2 * (w @ w), g / n + penalty * w))
            except StopIteration as done:
                found[k] = done.value
                del points[k]
    return np.array([found[k] for k in range(len(grid))])


def tfidf_experiment(df: DataFrame, key: str, text: str = "text", label: str = "label", split: str = "split", domain: str = "domain", kind: str = "word_1_2", grid: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> tuple[dict, list[dict]]:
    """Scores on test, and by domain, of the strength with the best macro-F1 on dev (of equal ones the first).

    Vocabulary and idf are train's alone. A null text counts as empty; a row
    without a known term has only the constant, one without a label takes no part. Train must hold both classes.
    To the driver go at most MAX_FEATURES terms and gradients.
    """
    return tfidf_experiments(df, key, text, label, split, domain, (kind,), grid)[0]


def tfidf_experiments(df: DataFrame, key: str, text: str = "text", label: str = "label", split: str = "split", domain: str = "domain", kinds: tuple[str, ...] = tuple(TERM_KINDS), grid: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> list[tuple[dict, list[dict]]]:
    """tfidf_experiment() of several kinds of terms, over rows that are kept once; the kinds run side by side."""
    context = df.sparkSession.sparkContext
    rows = df.filter(F.col(label).isNotNull()).select(key, F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(split).alias("split"), F.col(domain).alias("domain"))
    n, classes, whole = rows.agg(F.count_if(F.col("split") == "train"), F.count_distinct(F.when(F.col("split") == "train", F.col("label"))), F.count("*")).first()
    if classes != 2:
        raise ValueError("training needs both classes")
    rows = rows.repartition(max(2 * context.defaultParallelism, whole // 2000 + 1), key).drop(key).persist()
    try:
        rows.count()  # else each kind would begin to make them
        with ThreadPoolExecutor(len(kinds)) as pool:
            # each its own copy of the caller's properties, as a running query writes its number into them
            running = [pool.submit(inheritable_thread_target(partial(fit_and_score, rows, n, kind, grid))) for kind in kinds]
            return [r.result() for r in running]
    finally:
        rows.unpersist()


def fit_and_score(rows: DataFrame, n: int, kind: str, grid: tuple[float, ...]) -> tuple[dict, list[dict]]:
    """The result of tfidf_experiment() for rows (text, label, split, domain), n of them in train; they are read several times."""
    from textloom.operators import stats

    ngrams, min_df, chars = TERM_KINDS[kind]
    context = rows.sparkSession.sparkContext
    train, rest = rows.filter("split = 'train'"), rows.filter("split IN ('dev', 'test')")
    terms = frequent_terms(train, n, ngrams, min_df, chars, MAX_FEATURES).toArrow()
    size = len(terms)
    known = context.broadcast((places_of(terms["term"].to_pylist(), ngrams, chars), terms["idf"].to_numpy()))

    flat = T.StructType.fromDDL("label int, at binary, weight binary")
    out = T.StructType([*rest.select("label", "split", "domain").schema, T.StructField("run", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("pred", T.IntegerType())])

    def packed(batches):
        rows = ({"label": row["label"], "at": at.tobytes(), "weight": weight.astype(np.float32).tobytes()} for row, at, weight in vectors(batches, known.value, ngrams, chars))
        return record_batches(rows, flat)

    def read(part):
        return in_blocks((r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["weight"], np.float32)) for r in part)

    # every job reads them all, and that is most of its time: so weights are kept in 32 bits (7 digits) and summed in 64
    blocks = train.select("text", "label").mapInArrow(packed, flat).rdd.mapPartitions(read).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # what is kept goes through as many tasks as there are cores, each of which hands on one gradient
        weights = penalised(blocks.coalesce(context.defaultParallelism), size + 1, n, grid)
    finally:
        blocks.unpersist()
    fitted = context.broadcast(weights)

    def judged(batches):
        every = ((row, fitted.value[:, at] @ weight) for row, at, weight in vectors(batches, known.value, ngrams, chars))
        return record_batches((row | {"run": k, "score": float(m), "pred": int(m > 0)} for row, margins in every for k, m in enumerate(margins)), out)

    scored = rest.select("text", "label", "split", "domain").mapInArrow(judged, out).persist()
    try:
        dev = {r["run"]: r["macro_f1"] for r in stats.scores(stats.confusion(scored.filter("split = 'dev'"), ["run"])).collect()}
        best = max(range(len(grid)), key=lambda k: (dev[k], -k))
        test = scored.filter((F.col("split") == "test") & (F.col("run") == best))
        whole = stats.scores(stats.confusion(test, ["run"])).first()
        auc = stats.roc_auc(test, [], "label", "score").first()["auc"]
        by_domain = stats.scores(stats.confusion(test, ["domain"])).orderBy("domain").collect()
    finally:
        scored.unpersist()
        known.destroy()
        fitted.destroy()
    summary = {"features": kind, "n_terms": size, "c": grid[best], "dev_macro_f1": dev[best], "test_macro_f1": whole["macro_f1"], "test_accuracy": whole["accuracy"], "test_roc_auc": auc}
    return summary, [{"features": kind, "domain": r["domain"], "test_macro_f1": r["macro_f1"]} for r in by_domain]


def logistic(train: DataFrame, features: list[str], label: str = "label", c: float = 1.0, max_iter: int = 200):
    """Standardise (by population deviations), then L2 logistic regression with strength c as scikit-learn counts it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = max(train.count(), 1)
    train = train.coalesce(n // 2000 + 1)  # every iteration is a job, so few rows go in few tasks
    penalty = (n - 1) / (c * n * n)  # the scaler divides by sample deviations; (n - 1) / n makes up for it
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol=label, regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=max_iter),
    ]).fit(train)


def predict(model, df: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keys, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("pred"))


def grid_search(train: DataFrame, dev: DataFrame, features: list[str], label: str, grid: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)):
    """The strength with the best macro-F1 on dev; of equal ones the first."""
    from textloom.operators import stats

    best = None
    for c in grid:
        model = logistic(train, features, label, c)
        row = stats.scores(stats.confusion(predict(model, dev, [label]).withColumn("k", F.lit(1)), ["k"], label)).first()
        if best is None or row["macro_f1"] > best[0]:
            best = (row["macro_f1"], c, model)
    return best


def save_model(model, path: str) -> None:
    """A fitted pipeline, in place of what is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A pipeline that save_model wrote."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
