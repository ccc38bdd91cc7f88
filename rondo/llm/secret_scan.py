"""Secret scan: patterns for known kinds and sliding-window entropy over candidate strings. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, regex_spans

#: Known kinds: pattern, captured group and its least length (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Candidate strings of the entropy scan and the least entropy (bits a character in a window) of each character class.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
CLASSES = [("hex", "[0-9a-fA-F]", 3.0), ("upper", "[A-Z0-9]", 3.4), ("base64", "[A-Za-z0-9+/=_-]", 3.7)]
BLOCK = 4096  # windows of a candidate that one fold goes through
#: Parts of a candidate that are left out, with no window over them: runs between separators that hold a placeholder's word, and UUIDs.
LEFT_OUT = (
    r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*(?i:example|sample|dummy|placeholder|changeme|xxxx)[A-Za-z0-9+]*"
    r"|(?<![A-Za-z0-9+])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9+])"
)


def _allowed(c: Column) -> Column:
    """Stretches that look random but are no secrets: numbers, plain words, paths. Each rule is one scan without nested repetition.

    Letters without digits are plain if their case changes as seldom as in words set side by side (a hump of six letters on average or more); a random
    string changes every fourth letter from lower to upper. A path or a dashed list is letters that are capital only where a part begins, with up to four digits at the end.
    """
    letters = c.rlike("^[A-Za-z_=+/-]+$") & (6 * F.size(F.regexp_extract_all(c, F.lit("[a-z][A-Z]"), F.lit(0))) <= F.length(c))
    path = ~F.regexp_replace(c, "[0-9]{1,4}$", "").rlike("[^A-Za-z_/-]|[A-Za-z][A-Z]")
    return c.rlike("^[0-9_=+/-]+$") | letters | path


def _entropy_windows(text: Column, width: int = WINDOW) -> Column:
    """Stretches of overlapping windows whose entropy reaches the bound of their class, as structs of the first and last start.

    A window is of the first class that holds all its characters; the state keeps the last place outside each class.

    The fold slides one character at a time. Of all counts only two change: that of the character that comes and of the one that goes; the
    state keeps the sum of n * log2(n) over characters, from which the entropy follows. Long texts are folded in blocks that share a window less one
    character, so that no list of stretches grows with the text; stretches that meet at a block's end are joined afterwards.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length(text) - width) / BLOCK).cast("int")), lambda b: b * BLOCK)
    shifted = lambda start: F.transform(_block_windows(F.substring(text, start + 1, F.lit(BLOCK + width - 1)), width), lambda w: F.struct(
        (w["first"] + start).alias("first"), (w["last"] + start).alias("last")))
    found = F.flatten(F.transform(blocks, shifted))

    def joined(all_: Column) -> Column:
        apart = lambda i: (i == 0) | (all_[i]["first"] > all_[F.greatest(i - 1, F.lit(0))]["last"] + width)
        firsts = F.filter(F.transform(all_, lambda w, i: F.when(apart(i), w["first"])), lambda x: x.isNotNull())
        lasts = F.filter(F.transform(all_, lambda w, i: F.when((i == F.size(all_) - 1) | apart(i + 1), w["last"])), lambda x: x.isNotNull())
        return F.zip_with(firsts, lasts, lambda a, z: F.struct(a.alias("first"), z.alias("last")))

    return F.when(F.length(text) <= BLOCK + width - 1, _block_windows(text, width)).otherwise(bind(found, joined))


def _block_windows(text: Column, width: int) -> Column:
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def of(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            held = F.slice(chars, F.greatest(F.lit(1), i - width + 1), F.least(i, F.lit(width)))
            count = lambda c, h: F.size(h) - F.size(F.array_remove(h, c))

            def moved(h: Column) -> Column:
                come, goes = chars[i], F.when(i >= width, F.get(chars, i - width))
                n = count(come, h)
                inner = bind(state["sum"] + term(n + 1) - term(n), lambda total: F.when(i < width, total).otherwise(bind(
                    F.when(goes == come, n + 1).otherwise(count(goes, h)), lambda m: total - term(m) + term(m - 1))))
                return bind(inner, lambda total: _updated(state, total, chars[i], i, width))

            return bind(held, moved)

        outside = [F.lit(-1).alias(name) for name, _, _ in CLASSES[:-1]]
        start = F.struct(F.lit(0.0).alias("sum"), *outside, F.array().cast("array<struct<first:int,last:int>>").alias("hot"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: s["hot"])

    return bind(F.filter(F.split(text, ""), lambda c: c != ""), of)


def _updated(state: Column, total: Column, come: Column, i: Column, width: int) -> Column:
    at = i - (width - 1)
    outside = [F.when(come.rlike(f"^{p}$"), state[name]).otherwise(i).alias(name) for name, p, _ in CLASSES[:-1]]
    least = F.lit(CLASSES[-1][2])
    for (_, _, bits), place in zip(reversed(CLASSES[:-1]), reversed(outside), strict=True):
        least = F.when(place < at, F.lit(bits)).otherwise(least)
    hot = (at >= 0) & (F.log2(F.lit(float(width))) - total / width >= least)
    this = lambda first: F.array(F.struct(first.cast("int").alias("first"), at.cast("int").alias("last")))
    before = F.get(state["hot"], F.size(state["hot"]) - 1)
    joins = before.isNotNull() & (at <= before["last"] + width)
    grown = F.when(joins, F.concat(F.slice(state["hot"], F.lit(1), F.size(state["hot"]) - 1), this(before["first"]))).otherwise(F.concat(state["hot"], this(at)))
    return F.struct(total.alias("sum"), *outside, F.when(hot, grown).otherwise(state["hot"]).alias("hot"))


def _parts(x: Column) -> Column:
    """Structs s, m of what a candidate holds beside ``LEFT_OUT``, parts shorter than a window dropped."""
    def between(gone: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda g: g["e"].cast("long")))
        ends = F.concat(F.transform(gone, lambda g: g["s"].cast("long")), F.array(F.length(x["m"]).cast("long")))
        return F.zip_with(starts, ends, lambda s, e: F.struct((x["s"] + s).cast("long").alias("s"), F.substring(x["m"], (s + 1).cast("int"), (e - s).cast("int")).alias("m")))

    whole = F.array(F.struct(x["s"].cast("long").alias("s"), x["m"].alias("m")))
    return F.when(x["m"].rlike(LEFT_OUT), F.filter(bind(regex_spans(x["m"], LEFT_OUT), between), lambda p: F.length(p["m"]) >= WINDOW)).otherwise(whole)


def _entropy_spans(text: Column) -> Column:
    """Structs s, e of the stretches of windows of high entropy in each candidate that no rule allows; each stretch is judged by itself."""
    parts = F.filter(F.flatten(F.transform(regex_spans(text, CANDIDATE), _parts)), lambda x: ~_allowed(x["m"]))

    def stretches(x: Column) -> Column:
        hot = F.filter(_entropy_windows(x["m"]), lambda w: ~_allowed(F.substring(x["m"], w["first"] + 1, w["last"] + WINDOW - w["first"])))
        return F.transform(hot, lambda w: F.struct((x["s"] + w["first"]).alias("s"), (x["s"] + w["last"] + WINDOW).alias("e")))

    return F.flatten(F.transform(parts, stretches))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then by the order of kinds."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row of documents all secrets: doc_id and ``found``, structs of s, rank, e (code points, end exclusive) and kind.

    Kinds: ``assign``, ``access`` and ``hex`` by pattern, leftmost and non-overlapping per kind, short ones dropped; ``entropy`` for stretches of
    candidate strings in which a window of 20 characters reaches its character class's entropy, unless an allow rule fits the stretch or a span
    of a known kind overlaps; runs with a placeholder's word and UUIDs are left out. NULL texts count as empty, NULL identifiers stay, repeated rows are scanned each, an empty table gives none.
    Only texts in which a pattern occurs are taken apart.
    """
    none = F.array().cast("array<struct<s:bigint,rank:int,e:bigint,kind:string>>")
    text = F.coalesce("text", F.lit(""))

    def kind(name: str, rank: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].cast("long").alias("s"), F.lit(rank).alias("rank"), x["e"].cast("long").alias("e"), F.lit(name).alias("kind")))

    def known(name: str, rank: int, pattern: str, group: int) -> Column:
        long = F.filter(regex_spans(F.col("text"), pattern, group), lambda x: F.length(x["v"]) >= LEAST[name])
        least = pattern[:-1] + f"{{{LEAST[name] - (4 if name == 'access' else 0)},}}" if not group else pattern
        return F.when(F.col("text").rlike(least), kind(name, rank, long)).otherwise(none).alias(name)

    parts = docs.select("doc_id", text.alias("text")).select(
        "doc_id", known("assign", 0, ASSIGN, 1), known("access", 1, ACCESS, 0), known("hex", 2, HEX, 0),
        F.when(F.col("text").rlike(CANDIDATE), kind("entropy", 3, _entropy_spans(F.col("text")))).otherwise(none).alias("entropy"))
    base = parts.select("doc_id", "entropy", F.concat("assign", "access", "hex").alias("base"))
    apart = F.filter("entropy", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return base.select("doc_id", F.concat("base", apart).alias("found"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts per known kind, digest of the known spans and the list of all spans: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    NULLs, empty and long texts, repeated rows and empty tables are as in ``secret_spans``.
    """
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"] != "entropy")
    return secret_spans(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), count("entropy"))
