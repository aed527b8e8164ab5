"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Every position of every text is hashed under fixed masks that ignore some token positions, so a replaced word spoils only
some of the seeds around it. Seeds of documents and benchmark items are joined; each hit fixes a shift between document and
item, and along that shift the matching tokens are compared: a stretch of positive score (a match counts 1, a difference -2) must
hold 13 equal tokens, or four fifths of a shorter item. Of the stretches that do, the best-scoring one is reported.

The seeds of documents stream through a broadcast of the item seeds while those number at most ``BROADCAST_SEEDS``; beyond,
both sides are shuffled by seed. Likewise hits are broadcast to the documents they came from up to ``BROADCAST_HITS``.
Items with equal text stand as one item, the smallest id. Hits are reduced to (document, item, shift) before any shuffle.

Defined results: tokens are lower-case runs of letters and digits; null and empty texts have none; items shorter than the
shortest mask (8 tokens) are never found; several rows with one ``doc_id`` count as one document, of which the best
stretch is reported; null ids are kept as a value of their own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.names import spare_name
from geoledger.session import cut

#: Token positions that a mask looks at: 11011011, 1110010101, 1010011011.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 9), (0, 2, 5, 6, 8, 9))
MIN_MATCHES = 13
SHORT_SHARE = 0.8
MISS = 2
BROADCAST_SEEDS = 2_000_000  # about 100 MB as a hash table
BROADCAST_HITS = 500_000

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+', 0)"
_HASHES = f"transform({_TOKENS}, x -> xxhash64(x))"


def _seed_list() -> str:
    """All seeds of a text: position times number of masks plus mask."""
    one = lambda k, mask: (f"if(i + {mask[-1]} < size(h), xxhash64({', '.join(f'h[i + {o}]' for o in mask)}, {k}), null)")
    seeds = ", ".join(one(k, mask) for k, mask in enumerate(MASKS))
    shortest = min(mask[-1] for mask in MASKS)
    return (f"transform(array({_HASHES}), h -> CASE WHEN size(h) > {shortest} THEN "
            f"flatten(transform(sequence(0, size(h) - {shortest} - 1), i -> array({seeds}))) END)[0]")


def _seeds(texts: DataFrame, key: str, at: str) -> DataFrame:
    """``key``, position ``at``, ``seed``."""
    return (texts.select(key, F.posexplode(F.expr(_seed_list())).alias("k", "seed")).where("seed is not null")
            .select(key, F.expr(f"k div {len(MASKS)}").cast("int").alias(at), "seed"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Distinct item texts with the smallest ``item_id`` of each."""
    return benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("text", "item_id"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: ``doc_id``, ``item_id``, ``n_matches``, ``n_span`` (tokens from the first to the last match), ``doc_token``
    (where it begins in the document); the best stretch of each document and item."""
    items = cut(benchmark_items(benchmark))
    item_seeds = _seeds(items, "item", "item_at").distinct()
    few = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if few * len(MASKS) / 2 <= BROADCAST_SEEDS:  # a token takes two characters at least
        item_seeds = F.broadcast(item_seeds)
    texts = docs.select("doc_id", "text")
    hits = cut(_seeds(texts, "doc_id", "doc_at").join(item_seeds, "seed")
               .groupBy("doc_id", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.lit(1).alias("hit")).drop("hit"))
    sized = items.select("item", "item_id", F.expr(_HASHES).alias("t"))
    wanted = hits.join(sized.select("item", F.size("t").alias("n_item")), "item")
    if hits.count() <= BROADCAST_HITS:  # four numbers a row
        wanted = F.broadcast(wanted)
    hashed = texts.select(F.col("doc_id").alias("id"), F.expr(_HASHES).alias("h"))
    low = F.greatest(F.lit(0), -F.col("shift"))
    aligned = (hashed.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")))
               .select("doc_id", "item", "shift", "n_item", low.alias("low"),
                       F.expr("slice(h, greatest(0, shift) + 1, n_item - greatest(0, -shift))").alias("d"))
               .where("size(d) > 0").join(sized, "item").withColumn("t", F.expr("slice(t, low + 1, size(t))")))
    # s, m: score and matches of the first k tokens; starts: where a match follows on the lowest score so far; the best-scoring stretch
    # with enough matches that ends here begins at the last start that leaves enough
    begun = ("if(v > 0 and (size(a.starts) = 0 or a.s <= element_at(a.starts, -1).s), "
             "concat(a.starts, array(named_struct('s', a.s, 'm', a.m, 'b', a.k))), a.starts)")
    last = "get(filter(starts, r -> r.m <= a.m + 1 - need), size(filter(starts, r -> r.m <= a.m + 1 - need)) - 1)"
    ended = ("transform(array(" + last + "), r -> if(v > 0 and r is not null and a.s + v > r.s, "
             "greatest(a.top, named_struct('s', a.s + v - r.s, 'm', a.m + 1 - r.m, 'n', a.k + 1 - r.b, 'b', r.b)), a.top))[0]")
    step = (f"transform(array({begun}), starts -> named_struct('k', a.k + 1, 'm', a.m + if(v > 0, 1, 0), 's', a.s + v, 'starts', starts, "
            f"'top', {ended}))[0]")
    start = ("named_struct('k', 0, 'm', 0, 's', 0, 'starts', cast(array() as array<struct<s: int, m: int, b: int>>), "
             "'top', named_struct('s', 0, 'm', 0, 'n', 0, 'b', 0))")
    need = F.least(F.lit(MIN_MATCHES), F.ceil(SHORT_SHARE * F.col("n_item"))).cast("int")
    scored = aligned.withColumn("need", need).select("doc_id", "item_id", "shift", "low", "need", F.expr(
        f"aggregate(zip_with(d, t, (p, q) -> if(p = q, 1, -{MISS})), {start}, (a, v) -> {step}, a -> a.top)").alias("top"))
    enough = (F.col("top.m") >= F.col("need")) & (F.col("top.s") > 0)
    best = F.max(F.struct(F.col("top.m").alias("n_matches"), F.col("top.n").alias("n_span"),
                          (F.col("shift") + F.col("low") + F.col("top.b")).alias("doc_token"))).alias("best")
    return scored.where(enough).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap with the benchmark, all columns kept."""
    leak = spare_name(docs, "leak")
    found = cut(find_overlaps(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct())
    if found.count() <= BROADCAST_HITS:
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
