"""Benchmark decontamination by winnowing.

Words are hashed, every k-gram of word hashes gets a hash, and of each sliding
window of w k-grams the smallest hash is a fingerprint. Any span of
w + k - 1 = `window` words that a document shares with an item therefore gives
both the same fingerprint. Documents are tested against a bitmap of the
benchmark's fingerprints in the scan, sized by their number and bounded: where no
k-gram is in it, no minimum can be, so only the others are winnowed. Fingerprints
that pass are joined with the benchmark's, and each (document, item, diagonal)
is extended word by word, so that what is reported is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bit_filter, bit_literal, materialise, might_contain, row_hash, text_of

#: Fixed by the contract: what lies between words, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the fingerprint bitmap at most (2 MB; 64 bits each up to 260,000 fingerprints, beyond it lets more through) and of the one for documents.
MAX_BITS, ID_BITS = 24, 22
#: A benchmark of at most so many words in all is broadcast; beyond it joins shuffle.
BROADCAST_WORDS = 4_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds value once, so that lambdas in body don't compute it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def grams(hashes: Column, k: int) -> Column:
    """Hash of each k-gram; empty where there are fewer than k words."""
    n = F.size(hashes)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))).otherwise(F.array().cast("array<bigint>"))


def winnow(gram_hashes: Column, w: int) -> Column:
    """Distinct minima of all windows of w k-grams."""
    n = F.size(gram_hashes)
    minima = F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.array_min(F.slice(gram_hashes, i, w)))
    return F.when(n >= w, F.array_distinct(minima)).otherwise(F.array().cast("array<bigint>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, k: int = 6, share: int = 20, rows: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it lies in an occurrence of `window` consecutive
    words of an item, or of a whole item of fewer words. contaminated: n_hit > 0
    and share * n_hit >= n_words. Null or wordless texts have no words and are
    never contaminated; such items match nothing; items of equal text count each.
    Documents are told apart by id and text, so rows that repeat an id, and rows
    without one, are judged each by its own text. An empty benchmark gives clean
    documents, no documents no rows. Columns not named are not read. With `rows`,
    a hash of id and text follows, to tell rows apart.
    """
    w = window - k + 1
    bench = items.select(F.col(item_col).cast("string").alias("item"), words_of(text_of(item_text_col)).alias("iw")).filter(F.size("iw") > 0)
    bench = materialise(bench.withColumn("ih", word_hashes(F.col("iw"))), "bench")
    short = sorted(r[0] for r in bench.filter(F.size("iw") < window).select(F.size("iw")).distinct().collect())
    n_words = bench.agg(F.sum(F.size("iw"))).first()[0] or 0
    near = F.broadcast if n_words <= BROADCAST_WORDS else (lambda df: df)

    whole = [bench.filter(F.size("iw") == n).select("item", F.lit(0).alias("ipos"), grams(F.col("ih"), n)[0].alias("h")) for n in short]
    fps = (
        bench.filter(F.size("iw") >= window)
        .select("item", let(grams(F.col("ih"), k), lambda g: let(winnow(g, w), lambda m: F.filter(F.transform(g, lambda x, i: F.struct(i.alias("ipos"), x.alias("h"))), lambda s: F.array_contains(m, s["h"])))).alias("f"))
        .select("item", F.explode("f").alias("f")).select("item", "f.ipos", "f.h")
    )
    for more in whole:
        fps = fps.unionByName(more)
    fps = materialise(fps, "fingerprints")
    log2_bits = min(MAX_BITS, max(10, (64 * fps.count()).bit_length()))
    bits = bit_literal(fps, "h", log2_bits)

    def candidates(h: Column) -> Column:
        """Positions (place, hash) of fingerprints that may be the benchmark's."""
        known = lambda x: might_contain(bits, x, log2_bits)
        none = F.array().cast("array<struct<pos:int,h:bigint>>")

        def pick(g: Column, minima: Callable[[Column], Column]) -> Column:
            """Places of g's minima that are in the bitmap; minima are sought only if some gram is."""
            of = lambda m: F.filter(F.transform(g, lambda x, i: F.struct(i.alias("pos"), x.alias("h"))), lambda s: known(s["h"]) & F.array_contains(m, s["h"]))
            return F.when(F.exists(g, known), let(F.filter(minima(g), known), of)).otherwise(none)

        parts = [let(grams(h, k), lambda g: pick(g, lambda x: winnow(x, w)))]
        parts += [let(grams(h, n), lambda g: pick(g, F.array_distinct)) for n in short]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    key = ["k", "t"]  # k: the id with null as "", t: hash of id and text
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), row_hash(id_col, text_col).alias("t"), words_of(text_of(text_col)).alias("words"))
    found = base.select("id", *key, let(F.col("words"), lambda ws: let(let(word_hashes(ws), candidates), lambda c: F.struct(F.size(ws).cast("long").alias("n_words"), c.alias("c"), F.when(F.size(c) > 0, ws).alias("words")))).alias("x"))
    found = materialise(found, "candidates")

    some = found.filter("size(x.c) > 0")
    aligned = (
        some.select(*key, F.explode("x.c").alias("c")).select(*key, "c.pos", "c.h")
        .join(near(fps), "h").select(*key, "item", (F.col("pos") - F.col("ipos")).alias("diagonal"))
        .groupBy(*key, "item").agg(F.collect_set("diagonal").alias("diagonals"))
    )
    aligned = materialise(aligned, "aligned")
    ids = bit_filter(aligned.select("t"), "t", ID_BITS).scalar()
    some = some.filter(might_contain(ids, F.col("t"), ID_BITS)).select(*key, "x.words").dropDuplicates(key)  # words of documents without a shared fingerprint aren't shuffled

    def occurrences(words: Column, iw: Column, diagonals: Column) -> Column:
        """Places of document words in windows that equal the item's, along the diagonals."""
        n = F.size(iw)
        length = F.least(n, F.lit(window))

        def along(d: Column) -> Column:
            same = F.array_join(F.transform(iw, lambda x, j: F.when((d + j >= 0) & F.equal_null(F.get(words, F.when(d + j >= 0, d + j).otherwise(0)), x), "1").otherwise("0")), "")
            starts = let(same, lambda s: F.filter(F.sequence(F.lit(0), n - length), lambda j: F.substring(s, j + 1, length) == F.repeat(F.lit("1"), length)))
            return F.flatten(F.transform(starts, lambda j: F.sequence(d + j, d + j + length - 1)))

        return F.array_distinct(F.flatten(F.transform(diagonals, along)))

    hits = (
        aligned.join(near(bench.select("item", "iw").dropDuplicates(["item", "iw"])), "item")
        .join(some, key)
        .select(*key, "item", occurrences(F.col("words"), F.col("iw"), F.col("diagonals")).alias("hit")).filter(F.size("hit") > 0)
        .groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    nothing = F.array().cast("array<string>")
    return (
        found.select("id", *key, "x.n_words").join(hits, key, "left")
        .select(
            F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", nothing)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", nothing), ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), *([F.col("t").alias("row_hash")] if rows else []),
        )
    )


SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
