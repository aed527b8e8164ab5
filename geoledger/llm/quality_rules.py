"""Quality rules by divergence from language references, in DataFrame functions only.

A text's histogram of character classes and its histogram of common words are compared with those of its language by
Jensen-Shannon distance (base 2, 0 to 1). The references are the summed histograms of the corpus' own documents of that
language that pass the base rules, so they cover all data and their size is fixed by the parameter ``COMMON_WORDS``.

Defined results: a null text has no words; a text under 50 words fails the base rules; texts with too few characters or
letter runs, and texts without a known language, are not judged by the distances and are kept if they pass the base rules;
repeated rows are judged one by one; an empty table gives an empty result. Only ``doc_id``, ``text``, ``lang`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.session import cut

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CHARS = 200
MIN_RUNS = 50
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.35

#: Frequent function words of four languages; any further language can be added.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as this by at are from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es lo".split(),
}

#: Character classes of the histogram; all other characters make one more class.
CLASSES = {
    "lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\x20\x09-\x0D",
    "stop": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>",
}
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for the value, which is computed once for each row."""
    return f"transform(array({value}), {name} -> {body})[0]"


_PAIRED = "transform(h, (x, i) -> named_struct('x', x, 'i', i))"
#: Positions of three-word windows that occur twice or more, in order; then the words they cover.
_AGAIN = ("array_sort(transform(filter(s, (v, k) -> (k > 0 and s[k - 1].x = v.x) or (k < size(s) - 1 and s[k + 1].x = v.x)), v -> v.i))")
_COVERED = ("aggregate(p, named_struct('n', 0, 'e', 0), (a, i) -> named_struct('n', a.n + i + 3 - greatest(a.e, i), 'e', i + 3), a -> a.n)")
_REPEATS = ("CASE WHEN size(w) < 3 THEN 0 ELSE "
            + _bind("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))", "h",
                    _bind(f"array_sort({_PAIRED})", "s", _bind(_AGAIN, "p", _COVERED))) + " END")


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def measure(docs: DataFrame) -> DataFrame:
    """Base figures and the two histograms of every text; one narrow pass."""
    word_figures = _bind(f"regexp_extract_all(t, {_literal(WORD)}, 0)", "w",
                         f"named_struct('n_words', cast(size(w) as long), 'n_repeat_words', cast({_REPEATS} as long))")
    lines = _bind(f"filter(split(t, '\\n', -1), l -> l rlike {_literal(WORD)})", "l", "cast(size(l) - size(array_distinct(l)) as long)")
    kept = lambda inside: f"length(regexp_replace(t, {_literal(f'[^{inside}]+')}, ''))"
    classes = "array(" + ", ".join(kept(p) for p in CLASSES.values()) + ")"
    count = lambda words: "array(" + ", ".join(f"size(filter(c, x -> x = '{w}'))" for w in words) + ")"
    within = lambda words: ", ".join(f"'{w}'" for w in words)
    common = "CASE " + " ".join(
        f"WHEN lang = '{lang}' THEN " + _bind(f"filter(r, x -> x in ({within(words)}))", "c", count(words))
        for lang, words in COMMON_WORDS.items()) + " END"
    runs = _bind(r"regexp_extract_all(lower(t), '\\p{L}+', 0)", "r", f"named_struct('n_runs', size(r), 'common', {common})")
    return (docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
            .select("doc_id", "lang", F.expr(word_figures).alias("w"), F.expr(lines).alias("n_dup_lines"),
                    F.expr(f"length(regexp_replace(t, {_literal(GAP)}, ''))").cast("long").alias("word_chars"),
                    F.expr("length(t)").alias("n_chars"), F.expr(classes).alias("classes"), F.expr(runs).alias("r"))
            .select("doc_id", "lang", "w.n_words", "word_chars", F.col("classes")[5].cast("long").alias("n_symbols"), "n_dup_lines",
                    "w.n_repeat_words", "n_chars", "classes", "r.n_runs", "r.common")
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per language the shares of character classes and of common words over all documents that pass the base rules."""
    size = len(CLASSES)
    words = max(map(len, COMMON_WORDS.values()))
    sums = (measured.where(~F.col("base_failed") & F.col("lang").isin(*COMMON_WORDS)).groupBy("lang")
            .agg(F.sum("n_chars").alias("n_chars"), F.sum("n_runs").alias("n_runs"),
                 F.array(*[F.sum(F.col("classes")[k]) for k in range(size)]).alias("classes"),
                 F.array(*[F.sum(F.get("common", F.lit(k))) for k in range(words)]).alias("common")))
    out = {}
    for row in sums.collect():  # one row for each language of the parameter
        classes, common = list(row["classes"]), [c for c in row["common"] if c is not None]
        out[row["lang"]] = ([c / max(row["n_chars"], 1) for c in [*classes, row["n_chars"] - sum(classes)]],
                            [c / max(row["n_runs"], 1) for c in [*common, row["n_runs"] - sum(common)]])
    return out


def _distance(counts: str, total: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance of the counts, with the rest of ``total`` as last class, from the reference shares."""
    shares = f"transform(concat({counts}, array({total} - aggregate({counts}, 0, (a, x) -> a + x))), x -> x / cast({total} as double))"
    q = "array(" + ", ".join(f"{v!r}D" for v in reference) + ")"
    side = lambda a: f"if({a} > 0, {a} * log2(2 * {a} / (p + q)), 0D)"
    terms = f"zip_with({shares}, {q}, (p, q) -> {side('p')} + {side('q')})"
    return F.expr(f"sqrt(greatest(0D, aggregate({terms}, 0D, (a, x) -> a + x) / 2))")


def judge(measured: DataFrame, reference: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds ``class_distance``, ``word_distance`` (null where not judged) and ``kept``."""
    by_class, by_word = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang, (classes, words) in sorted(reference.items()):
        mine = F.col("lang") == lang
        by_class = F.when(mine & (F.col("n_chars") >= MIN_CHARS), _distance("classes", "n_chars", classes)).otherwise(by_class)
        by_word = F.when(mine & (F.col("n_runs") >= MIN_RUNS), _distance("common", "n_runs", words)).otherwise(by_word)
    far = F.coalesce(by_class > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(by_word > MAX_WORD_DISTANCE, F.lit(False))
    return (measured.withColumn("class_distance", by_class).withColumn("word_distance", by_word)
            .withColumn("kept", ~F.col("base_failed") & ~far))


def apply_rules(docs: DataFrame) -> DataFrame:
    """The rules on every document. The small table of figures is written once and read for references and verdicts."""
    measured = cut(measure(docs))
    return judge(measured, references(measured))
