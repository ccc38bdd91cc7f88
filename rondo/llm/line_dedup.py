"""Line dedup: lines within one edit of an earlier line go, found by a deletion-neighbourhood join. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table, release

from .text import WHITE_CHARS, bind, small

MIN_CHARS = 20  # of a line that is compared with others by edits; shorter ones go as exact repeats only
PIECE = 64  # characters of a line hashed at a time


def _pieces(line: Column, shift: int, n: Column) -> Column:
    """Pieces of the line from ``shift`` on; places count from the start of the piece's own line, so an earlier deletion moves them by one."""
    last = F.floor((n - 1) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.substring(line, j * PIECE + 1 + shift, F.lit(PIECE)))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def _deletions(line: Column, opened: Column) -> Column:
    """Structs of the hashed key and the place of every variant with one character less, and of the line itself (place -1).

    Only places in the open stretches (``_quarters``) are deleted.

    A key is the exclusive or of the hashes of the variant's pieces and their places. A deletion in piece j leaves the pieces before it, and those
    after it are the pieces of the line moved by one, so a variant costs the hash of one piece and not of the whole line.
    """
    hashed = lambda p, j: F.when(F.length(p) > 0, F.xxhash64(p, j)).otherwise(F.lit(0).cast("long"))
    n = F.length(line)

    def of(plain: Column, moved: Column, stretches: Column) -> Column:
        heads, tails = F.transform(plain, hashed), F.transform(moved, hashed)
        itself = F.array(F.struct(_xor(heads).alias("key"), F.lit(-1).alias("at")))
        return F.concat(itself, bind(heads, lambda h: bind(tails, lambda t: F.flatten(F.transform(plain, lambda p, j: _in_piece(p, j, moved, h, t, stretches))))))

    def _in_piece(p: Column, j: Column, moved: Column, heads: Column, tails: Column, stretches: Column) -> Column:
        rest = _xor(F.slice(heads, F.lit(1), j)).bitwiseXOR(_xor(F.slice(tails, j + 2, F.size(tails))))
        widened = F.concat(p, F.substring(F.coalesce(F.get(moved, j), F.lit("")), F.length(p), F.lit(1)))
        variant = lambda w, i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w)))
        places = F.filter(F.sequence(F.lit(0), F.length(p) - 1), lambda i: F.exists(stretches, lambda x: (j * PIECE + i).between(x["low"], x["high"])))
        return bind(rest, lambda r: bind(widened, lambda w: F.transform(
            places, lambda i: F.struct(r.bitwiseXOR(hashed(variant(w, i), j)).alias("key"), (j * PIECE + i).alias("at")))))

    stretches = F.transform(opened, lambda o: F.struct(((3 - o["kind"]) * o["q"]).alias("low"), (n - 1 - o["kind"] * o["q"]).alias("high")))
    return bind(_pieces(line, 0, n), lambda plain: bind(_pieces(line, 1, n), lambda moved: bind(stretches, lambda x: of(plain, moved, x))))


def _quarters(line: Column) -> Column:
    """Keys of all of a line but one quarter, as structs of key, kind (quarters taken from the end) and q (characters of a quarter).

    Two lines within one edit agree in three quarters of the shorter one, counted from the start before the edit and from the end after it, so they share the
    key that leaves out the stretch of the edit: from place (3 - kind) * q to the last kind * q characters.

    The stretches are hashed by quarters, so that each is read once.
    """

    def of(n: Column) -> Column:
        sizes = F.array_distinct(F.array(F.floor((n - 1) / 4).cast("int"), F.floor(n / 4).cast("int")))
        head = lambda q, i: F.xxhash64(F.substring(line, i * q + 1, q)).alias(f"h{i}")
        tail = lambda q, i: F.xxhash64(F.substring(line, n - (i + 1) * q + 1, q)).alias(f"t{i}")
        hashed = F.transform(sizes, lambda q: F.struct(q.alias("q"), *[head(q, i) for i in range(3)], *[tail(q, i) for i in range(3)]))
        key = lambda s, kind: F.xxhash64(F.lit(kind), s["q"], *[s[f"h{i}"] for i in range(3 - kind)], *[s[f"t{i}"] for i in range(kind)])
        return F.flatten(F.transform(hashed, lambda s: F.array(*[F.struct(key(s, k).alias("key"), F.lit(k).alias("kind"), s["q"].alias("q")) for k in range(4)])))

    return bind(F.length(line), of)


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    lines = split.select("doc_id", "line_no", F.btrim("raw", F.lit(WHITE_CHARS)).alias("line")).filter(F.length("line") >= shortest)
    return lines.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def repeated_lines(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """Places of lines that come within one edit (insertion, deletion or substitution of a character) of an earlier line, itself dropped or not.

    Lines are parts of a text between line feeds, without white space at their ends; those under ``shortest`` characters (1: blank ones) are left
    alone, those under ``MIN_CHARS`` go only as exact repeats. Earlier means a smaller (doc_id, line number). Equal lines are counted once and stand for their earliest place. Only lines that share all
    but a quarter with another line (a necessary condition) emit the keys of their deletion neighbourhood, and only for deletions in that quarter. Variants that agree
    in key and place come from lines that differ in that place; a variant that equals a whole line comes from one with a character more. So the earliest line
    of each group is a partner of every other one, groups need no pairs, and the edit distance to that partner is verified on the lines.

    NULL texts have no lines. Rows with a NULL identifier are left alone. Rows that share an identifier and place keep or lose the line alike. An empty table gives none.
    Columns: doc_id, line_no (from 0).
    """
    lines = _lines(docs.filter(F.col("doc_id").isNotNull()), shortest)
    place = F.struct("doc_id", "line_no")
    distinct = persist_table(lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies")))
    keyed = lines.filter(F.length("line") >= MIN_CHARS).select("h", "h2", F.explode(_quarters(F.col("line"))).alias("k")).select("h", "h2", "k.key", "k.kind", "k.q")
    keyed = persist_table(keyed)
    crowded = persist_table(keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low != high").select("key"))
    shared = persist_table(keyed.join(small(crowded), "key").groupBy("h", "h2").agg(F.collect_set(F.struct("kind", "q")).alias("opened")))
    release(keyed, crowded)
    near = _near_lines(lines, distinct, shared)
    bound = distinct.join(near, ["h", "h2"], "left").select("h", "h2", F.least("first", "partner").alias("earliest"), (F.col("copies") > 1).alias("again"))
    bound = persist_table(bound.filter(F.col("again") | F.col("earliest").isNotNull()))
    release(distinct, shared, near)
    found = lines.select("doc_id", "line_no", "h", "h2").join(small(bound), ["h", "h2"])
    return found.filter(F.col("earliest") < F.struct("doc_id", "line_no")).select("doc_id", "line_no")


def _near_lines(lines: DataFrame, distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """For lines of ``shared`` with an earlier line one edit away: hashes and the partner's place."""
    firsts = persist_table(distinct.join(small(shared), ["h", "h2"]).select("h", "h2", "first", "opened"))
    texts = lines.join(small(firsts), ["h", "h2"]).filter(F.col("first") == F.struct("doc_id", "line_no")).select("h", "h2", "first", "line", "opened")
    texts = persist_table(texts.dropDuplicates(["h", "h2"]))
    variants = texts.select("h", "h2", "first", F.explode(_deletions(F.col("line"), F.col("opened"))).alias("v")).select("h", "h2", "first", "v.key", "v.at")
    other = F.when(F.col("at") >= 0, F.col("at"))
    groups = variants.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low != high").select("key")
    met = persist_table(variants.join(groups, "key"))
    replaced = met.filter(other.isNotNull()).groupBy("key", "at").agg(F.min("first").alias("partner"))
    whole = met.filter("at = -1").groupBy("key").agg(F.min("first").alias("partner"))
    longer = met.filter("at >= 0").groupBy("key").agg(F.min("first").alias("partner"))
    pairs = (
        met.join(replaced, ["key", "at"]).unionByName(met.filter("at >= 0").join(whole, "key")).unionByName(met.filter("at = -1").join(longer, "key"))
    ).filter(F.col("partner") < F.col("first")).select("h", "h2", "partner").distinct()
    mine = texts.select("h", "h2", F.col("line").alias("mine"))
    theirs = texts.select(F.col("first").alias("partner"), F.col("line").alias("theirs"))
    verified = pairs.join(mine, ["h", "h2"]).join(theirs, "partner").filter(F.levenshtein("mine", "theirs", 1).between(0, 1))
    near = persist_table(verified.groupBy("h", "h2").agg(F.min("partner").alias("partner")))
    release(firsts, texts, met)
    return near


def _without(lines: Column, gone: Column) -> Column:
    """The lines but those at the ascending places ``gone``: the stretches between them, each copied once."""
    stretches = lambda g: F.transform(F.sequence(F.lit(0), F.size(g)), lambda j: bind(
        F.when(j > 0, F.get(g, j - 1) + 1).otherwise(0), lambda start: F.slice(lines, start + 1, F.coalesce(F.get(g, j), F.size(lines)) - start)))
    return F.flatten(bind(gone, stretches))


def _kept_lines(docs: DataFrame, shortest: int) -> tuple[DataFrame, Column, Column]:
    """The documents beside the places of their repeated lines (NULL if none), and the text without them."""
    gone = persist_table(repeated_lines(docs, shortest).groupBy(F.col("doc_id").alias("gone_id")).agg(F.sort_array(F.collect_set("line_no")).alias("gone_lines")))
    marked = docs.join(small(gone), docs["doc_id"] == gone["gone_id"], "left")
    kept = bind(F.split(docs["text"], "\n"), lambda lines: F.array_join(_without(lines, gone["gone_lines"]), "\n"))
    return marked, gone["gone_lines"], F.when(gone["gone_lines"].isNull(), docs["text"]).otherwise(kept)


def dedup_lines(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """The documents without their repeated lines (``repeated_lines``): all columns stay, ``text`` holds the lines left, joined by line feeds.

    A text without repeated lines stays as it is, NULL stays NULL, and a document that loses all its lines stays with an empty text. Of equal lines the one
    in the smallest (doc_id, line number) stays; rows with a NULL identifier keep all their lines, rows that share one are taken for one document and
    lose the same line numbers. An empty table gives an empty result.
    """
    marked, _, text = _kept_lines(docs, shortest)
    return marked.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_lines before, n_dropped and text_sha256, the digest of the text left (NULL counts as empty). Ties, repeated rows
    and NULL identifiers are as in ``dedup_lines``."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked, gone, text = _kept_lines(plain, 1)
    n_lines = F.size(F.split(plain["text"], "\n")).cast("long")
    return marked.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


ORACLE = """
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
lines AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM raw),
firsts AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS place, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
near AS (
  SELECT b.line, a.place FROM firsts a JOIN firsts b ON left(a.line, 9) = left(b.line, 9) WHERE a.n >= 20 AND b.n >= 20 AND a.place < b.place AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1
  UNION ALL
  SELECT b.line, a.place FROM firsts a JOIN firsts b ON right(a.line, 9) = right(b.line, 9) WHERE a.n >= 20 AND b.n >= 20 AND a.place < b.place AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1),
bound AS (SELECT line, min(place) AS place FROM (SELECT line, place FROM firsts UNION ALL SELECT line, place FROM near) GROUP BY line),
marked AS (SELECT l.*, coalesce(b.place < {'d': l.doc_id, 'n': l.line_no}, false) AS gone FROM lines l LEFT JOIN bound b ON l.line = b.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
