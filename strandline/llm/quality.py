"""Quality rules on whole texts with DataFrame functions only: base rules and distribution divergence.

Each document's histogram of character classes, and of its language's commonest words, is compared
with a reference of that language by the Jensen-Shannon distance (base 2, so 0 to 1). A histogram of
few observations is noise, so each distance counts only from a minimum length on. Everything is
computed inside the row: there is no shuffle, and the references are a handful of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes of the non-space characters, in the order of the references' shares.
CLASSES = ("lower", "upper", "digit", "symbol", "punctuation", "other")
#: Shares of the classes in ordinary prose of each language (fixed values, fitted by ``fit_references`` on the
#: documents of the driver's sf0.1 tables whose label ``quality`` is 1).
CLASS_SHARES = {
    "de": [0.9141, 0.0145, 0.0005, 0.0, 0.0258, 0.0451],
    "en": [0.9542, 0.0166, 0.0007, 0.0, 0.0284, 0.0001],
    "es": [0.8640, 0.0143, 0.0010, 0.0, 0.0274, 0.0933],
    "fr": [0.8492, 0.0124, 0.0010, 0.0, 0.0286, 0.1088],
}
#: Common words of each language with their share of all words, counted as they are when scored (fixed values,
#: fitted likewise).
COMMON_WORDS = {
    "de": {"der": 0.0622, "die": 0.0366, "und": 0.0263, "in": 0.0200, "den": 0.0162, "von": 0.0136, "zu": 0.0111, "das": 0.0109, "mit": 0.0093, "sich": 0.0084, "des": 0.0079, "auf": 0.0072},
    "en": {"the": 0.0629, "of": 0.0365, "and": 0.0264, "to": 0.0200, "a": 0.0158, "in": 0.0139, "is": 0.0117, "that": 0.0106, "it": 0.0094, "for": 0.0085, "was": 0.0079, "on": 0.0073},
    "es": {"de": 0.0622, "la": 0.0364, "que": 0.0255, "el": 0.0199, "en": 0.0163, "y": 0.0137, "los": 0.0116, "se": 0.0102, "las": 0.0095, "del": 0.0092, "un": 0.0081, "por": 0.0077},
    "fr": {"de": 0.0625, "la": 0.0378, "le": 0.0253, "et": 0.0208, "les": 0.0164, "des": 0.0140, "en": 0.0125, "un": 0.0108, "du": 0.0091, "une": 0.0080, "que": 0.0077, "pour": 0.0074},
}
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.32

SPACE = "[ \\t-\\r]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    count = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.when(F.instr(text, "\n") > 0, count).otherwise(0).cast("long")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every five-word window, from the hashes of its words."""

    def windows(ones):
        heads = F.slice(ones, 1, F.size(ones) - 4)
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(ones, i + k) for k in range(1, 5)]))

    return let(F.transform(words, lambda x: F.xxhash64(x)), windows)


def repeated_words(words: Column) -> Column:
    """Number of words inside a five-word window that occurs twice or more in ``words``."""

    def repeated(ordered):
        def same(i, j):
            return F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, j)["h"], F.lit(False))

        index = F.sequence(F.lit(0), F.size(ordered) - 1)
        hits = F.filter(index, lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(hits, lambda j: F.get(ordered, j)["i"]))

    def covered(places):
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda x, y: F.least(F.lit(5), y - x))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(5)))

    def counted(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, lambda s: let(repeated(s), covered)))

    return F.when(F.size(words) < 5, 0).otherwise(let(window_hashes(words), counted)).cast("long")


def class_counts(rest: Column, word_chars: Column) -> list[Column]:
    """Counts of ``CLASSES``; ``rest`` is the text's words without the characters a-z."""

    def left(pattern):
        return F.length(F.regexp_replace(rest, f"[^{pattern}]+", ""))

    named = [left("A-Z"), left("0-9"), left("#*$%&|<>"), left(".,;:!?'\"()\\-")]
    return [word_chars - F.length(rest), *named]


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance between a histogram of counts and a distribution of the same length."""

    def term(p, q):
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    parts = let(total, lambda n: F.zip_with(counts, shares, lambda c, q: term(F.when(n > 0, c / n).otherwise(0.0), q)))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _references() -> Column:
    def doubles(values):
        return F.array(*[F.lit(float(v)) for v in values])

    return F.array(
        *[
            F.struct(
                F.lit(lang).alias("lang"),
                doubles(CLASS_SHARES[lang]).alias("classes"),
                F.array(*[F.lit(w) for w in COMMON_WORDS[lang]]).alias("words"),
                doubles([*COMMON_WORDS[lang].values(), 1 - sum(COMMON_WORDS[lang].values())]).alias("shares"),
            )
            for lang in sorted(CLASS_SHARES)
        ]
    )


def measured(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The columns of ``docs`` that are used (``keep`` as one struct), with the base counts and class counts."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(c) for c in keep or ["doc_id"]]).alias("row")
    df = docs.select("doc_id", lang.alias("lang"), text.alias("text"), row)
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.select("doc_id", "lang", "text", "row", "words", F.array_join("words", "").alias("solid"))
    df = df.select("*", F.length("solid").cast("long").alias("word_chars"), F.regexp_replace("solid", "[a-z]+", "").alias("rest"))
    named = class_counts(F.col("rest"), F.col("word_chars"))
    return df.select(
        "doc_id",
        "lang",
        "row",
        picked_words(F.col("words")).alias("picked"),
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        F.array(*[c.cast("long") for c in named]).alias("named"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def histogram_classes() -> Column:
    """Counts of CLASSES from ``measured``: the last one is what no named class holds."""
    rest = F.col("word_chars") - F.aggregate("named", F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat("named", F.array(rest)), lambda x: x.cast("double"))


def letter_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}]+"), "")


def picked_words(words: Column, listed: list[str] | None = None) -> Column:
    """The listed common words among ``words``, bare: lower-case or capitalised, a full stop or comma after it or not."""
    listed = listed or sorted({w for v in COMMON_WORDS.values() for w in v})
    forms = [f + end for w in listed for f in (w, w.capitalize()) for end in ("", ".", ",")]
    return F.transform(F.filter(words, lambda x: x.isin(forms)), lambda x: F.lower(F.rtrim(x, F.lit(".,"))))


def fit_references(docs: DataFrame, k: int = 12) -> tuple[dict, dict]:
    """Class shares and the ``k`` commonest words for each language of trusted documents (a small result).

    Words are chosen by letters alone, then counted in the spellings that a score counts.
    """
    known = docs.filter("lang is not null")
    sums = measured(known).groupBy("lang").agg(*[F.sum(histogram_classes()[i]).alias(c) for i, c in enumerate(CLASSES)]).collect()
    classes = {r["lang"]: [round(r[c] / sum(r[x] for x in CLASSES), 4) for c in CLASSES] for r in sums}
    words = known.select("lang", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum(F.size("words")).alias("n")).collect()}
    letters = known.select("lang", F.explode(letter_words(F.coalesce("text", F.lit("")))).alias("w")).groupBy("lang", "w").count()
    common = {}
    for lang in classes:
        top = [r["w"] for r in letters.filter(F.col("lang") == lang).orderBy(F.desc("count"), "w").limit(k).collect()]
        seen = words.filter(F.col("lang") == lang).select(F.explode(picked_words(F.col("words"), top)).alias("w")).groupBy("w").count().collect()
        counts = {r["w"]: r["count"] for r in seen}
        common[lang] = {w: round(counts.get(w, 0) / totals[lang], 4) for w in top}
    return classes, common


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def quality(docs: DataFrame, keep: list[str] = (), nearest: bool = True) -> DataFrame:
    """Base counts, distances and verdict for every row of ``docs``, after the columns ``keep``.

    A null text counts as empty: no words, so ``base_failed``. The reference is that of the row's
    ``lang``; where that is null, absent or has none, the nearest reference. Without ``nearest`` a language
    that has none is judged by the base rules only, and its distances are null. A distance is null below
    its minimum length (``MIN_CHARS``, ``MIN_WORDS``) and then rejects nothing. A distance equal to its limit
    passes. A text of any length is one row's work. Repeated rows and ids give repeated results; columns that
    are not in ``keep`` are ignored, and of two columns of one name the result of this operator stands; an
    empty table gives no rows.
    """
    keep = [c for c in keep or ["doc_id"] if c not in OUTPUT]
    df = measured(docs, keep)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    every = _references()
    own = F.filter(every, lambda r: r["lang"] == F.col("lang"))
    others = F.lit(True) if nearest else F.col("lang").isNull()
    refs = let(own, lambda r: F.when((F.size(r) == 0) & others, every).otherwise(r))
    df = df.withColumn("base_failed", failed).withColumn("histogram", histogram_classes())
    class_distance = F.array_min(F.transform(refs, lambda r: js_distance(F.col("histogram"), r["classes"])))

    def counted(picked, r):
        seen = F.transform(r["words"], lambda w: F.size(F.filter(picked, lambda x: x == w)).cast("double"))
        rest = F.col("n_words").cast("double") - F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
        return F.concat(seen, F.array(rest))

    def word_distance(picked):
        return F.array_min(F.transform(refs, lambda r: let(counted(picked, r), lambda h: js_distance(h, r["shares"]))))

    df = df.withColumn("class_distance", F.when(~F.col("base_failed") & (F.col("word_chars") >= MIN_CHARS), class_distance))
    df = df.withColumn("word_distance", F.when(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS), let(F.col("picked"), word_distance)))
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return df.select(
        *[F.col(f"row.{c}") for c in keep],
        "n_words",
        "word_chars",
        F.col("named")[3].alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~diverges).alias("kept"),
        "class_distance",
        "word_distance",
    )


def passing(docs: DataFrame, keep: list[str], nearest: bool = True) -> DataFrame:
    """The columns ``keep`` of the rows that ``quality`` keeps.

    A plain filter would be pushed below the projections that compute the verdict, each of which would then
    be repeated wherever it is used. A generator that yields one element or none keeps them in place.
    """
    verdict = quality(docs, keep, nearest).select(*keep, F.explode(F.when(F.col("kept"), F.array(F.lit(True)))).alias("passes"))
    return verdict.drop("passes")
