"""Quality rules over documents: counts of repetition and a distribution-divergence verdict. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

from .text import bind, row_keys, same, small, total, words

#: The most common words of the languages served (fixed values).
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "as", "by", "are", "from", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "ein", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "dans", "que", "pour", "qui", "sur", "est", "au", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"],
}
#: Most of a text is lower-case letters and white space; the other classes are counted in what is left (fixed values).
LOWER_OR_WHITE = r"[\p{Ll}\x20\x09-\x0D]+"
CLASSES = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "point": r"[.,;:!?'\"()\[\]¿¡-]+"}
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def _packed(hashes: Column) -> Column:
    """Hashes that may repeat, sorted: the low bits of each are replaced by its place, so that plain numbers sort. Empty if none repeats."""
    packed = bind(_place_mask(hashes), lambda mask: bind(hashes, lambda hs: F.transform(hs, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<bigint>")).otherwise(F.sort_array(packed))


def _place_mask(hashes: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(hashes) + 1)).cast("int")) - 1


def _repeat_words(hashes: Column, packed: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text (first ones included)."""
    step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(width).cast("long"), at - acc["last"])).alias("n"), at.alias("last"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))

    def places(o: Column, mask: Column, hs: Column) -> Column:
        place = lambda x: x.bitwiseAND(mask).cast("int")
        twin = lambda x, y: x.bitwiseXOR(y).between(F.lit(0), mask) & (F.get(hs, place(x)) == F.get(hs, place(y)))
        return F.transform(F.filter(o, lambda x, i: twin(x, F.get(o, i - 1)) | twin(x, F.get(o, i + 1))), lambda x: x.bitwiseAND(mask))

    found = bind(_place_mask(hashes), lambda mask: bind(hashes, lambda hs: bind(packed, lambda o: places(o, mask, hs))))
    return F.when(F.size(packed) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sort_array(found), start, step, lambda acc: acc["n"]))


def _windows(w: Column, width: int = 3) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(width)), lambda i: F.xxhash64(*[w[i + F.lit(k)] for k in range(width)]))
    return F.when(F.size(w) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def _occurrences(listed: list[str]):
    return lambda found: F.array(*[(F.size(found) - F.size(F.array_remove(found, w))).cast("long") for w in listed])


def text_counts(docs: DataFrame) -> DataFrame:
    """One row per document: contract counts, characters per class and counts of the language's common words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    common = F.filter(F.col("w"), lambda x: x.isin(every))
    per_lang = F.lit(None).cast("array<bigint>")
    for lang, listed in COMMON_WORDS.items():
        per_lang = F.when(F.col("lang") == lang, bind(common, _occurrences(listed))).otherwise(per_lang)
    rest = F.regexp_replace("text", LOWER_OR_WHITE, "")
    base = docs.select("doc_id", "lang", text.alias("text"), words(F.col("text")).alias("w"))
    base = base.select("*", _windows(F.col("w")).alias("windows"), rest.alias("rest"), F.length("text").cast("long").alias("n_chars"), F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"))
    base = base.withColumn("packed", _packed(F.col("windows")))
    lower = F.col("word_chars") - F.length("rest")
    classes = [lower] + [(F.length("rest") - F.length(F.regexp_replace("rest", p, ""))).cast("long") for p in CLASSES.values()]
    return base.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), "n_chars", "word_chars",
        (F.length("rest") - F.length(F.regexp_replace("rest", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("windows"), F.col("packed")).alias("n_repeat_words"),
        F.array(*classes).alias("classes"), per_lang.alias("common"),
    )


def _histogram(parts: Column, whole: Column) -> Column:
    """Shares of the parts and of what is left of the whole."""
    share = lambda p: F.concat(F.transform(p, lambda x: x / whole), F.array(F.greatest(F.lit(0.0), 1 - total(p) / whole)))
    return F.when(whole > 0, bind(parts, share))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of one length."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def quality_rules(docs: DataFrame, max_class_distance: float = 0.3, max_word_distance: float = 0.3, min_chars: int = 200, min_judged_words: int = 100, min_reference_words: int = 1000) -> DataFrame:
    """Rule counts and the verdict of every document.

    The base rule fails documents under 50 words or with more than half of their words in repeated three-word windows. The
    others are compared with their language: shares of character classes (lower, upper, digit, punctuation, white space, rest) and shares of
    the common words, each against the language's totals over all documents, by Jensen-Shannon distance. Guards: no class verdict
    under ``min_chars`` characters, no word verdict under ``min_judged_words`` words or without a word list, none at all where the
    language's other documents hold under ``min_reference_words`` words. Documents that fail the base rule don't enter the references.

    NULL texts count as empty (zero counts, base_failed). NULL languages form a language without a word list. Repeated rows are judged each.
    An empty table gives an empty result. Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance. The text is read once; only counts are stored and joined with one row per language.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = persist_table(text_counts(docs.select("doc_id", "text", "lang")).withColumn("base_failed", failed))
    n_common = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"k{i}") for i in range(1 + len(CLASSES))] + [F.sum(F.get("common", F.lit(i))).alias(f"c{i}") for i in range(n_common)]
    per = counts.filter(~F.col("base_failed")).groupBy("lang").agg(F.sum("n_words").alias("ref_words"), F.sum("n_chars").alias("ref_chars"), F.sum(F.col("n_chars") - F.col("word_chars")).alias("ref_white"), *sums)
    refs = per.select(
        F.col("lang").alias("ref_lang"), "ref_words", _histogram(F.array("ref_white", *[f"k{i}" for i in range(1 + len(CLASSES))]), F.col("ref_chars")).alias("ref_class"),
        F.when(F.col("c0").isNotNull(), _histogram(F.array(*[f"c{i}" for i in range(n_common)]), F.col("ref_words"))).alias("ref_common"))
    own_class = _histogram(F.concat(F.array(F.col("n_chars") - F.col("word_chars")), F.col("classes")), F.col("n_chars"))
    judged = counts.join(persist_table(refs), same(F.col("lang"), F.col("ref_lang")), "left")
    enough = F.col("ref_words") >= min_reference_words
    class_distance = F.when(enough & (F.col("n_chars") >= min_chars), js_distance(own_class, F.col("ref_class")))
    word_distance = F.when(enough & (F.col("n_words") >= min_judged_words), js_distance(_histogram(F.col("common"), F.col("n_words")), F.col("ref_common")))
    far = F.coalesce(class_distance > max_class_distance, F.lit(False)) | F.coalesce(word_distance > max_word_distance, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
        class_distance.alias("class_distance"), word_distance.alias("word_distance"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents without those that the rules reject; all columns stay. Every row is judged by its own text, whatever its identifier."""
    keyed, key = row_keys(docs)
    gone = persist_table(quality_rules(keyed.select(F.col(key).alias("doc_id"), "text", "lang")).filter(~F.col("kept")).select(F.col("doc_id").alias(key)))
    return keyed.join(small(gone), key, "left_anti").select(*docs.columns)
