"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then score every document together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

LABELLED, POOL = 20_000, 20_000  # bounds of the labelled sample and of the pool of unlabelled rows
ROUNDS, PER_ROUND, CONFIDENT = 5, 400, 0.95
HELD_OUT = 5  # one labelled row in so many is kept for calibration
LANGS, SOURCES, SIZES = 8, 32, 12  # buckets of the metadata view
PUNCT, SYMBOL = b".,;:!?'\"()-", b"#*$%&|<>@^~=+_/\\{}[]"
LOWER, UPPER, DIGIT, HIGH = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))


def text_view(text: str | None) -> list[float]:
    """Dense features of the whole text: shares of character classes, variety, repetition, word and line shapes."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w = max(1, len(data)), max(1, len(words))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        share(LOWER), share(UPPER), share(DIGIT), share(b" \t\n\r\v\f"), share(PUNCT), share(SYMBOL), share(HIGH),
        len(counts) / w, max(counts.values(), default=0) / w, len(pairs) / max(1, w - 1), max(pairs.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        float(lengths.mean()) / 10, float(lengths.std()) / 10, float((lengths <= 3).mean()), sum(x.isupper() for x in words) / w, sum(x[-1] in SYMBOL for x in words) / w, sum(x[-1] in PUNCT for x in words) / w,
        np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)) / 100,
    ]


def _text_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        views = pa.array([text_view(t.as_py()) for t in rows.column("text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("page"), views], ["doc_id", "page", "words"])


def _page_view() -> Column:
    """Metadata features: language and source in hashed buckets, size in steps of powers of two; NULLs have buckets of their own."""
    one_hot = lambda value, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == value, 1.0).otherwise(0.0))
    bucket = lambda c, n: F.when(F.col(c).isNull(), F.lit(n - 1)).otherwise(F.pmod(F.xxhash64(c), F.lit(n - 1)).cast("int"))
    size = F.least(F.lit(SIZES - 2), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)).cast("double") / 32)))).cast("int")
    return F.concat(one_hot(bucket("lang", LANGS), LANGS), one_hot(bucket("source", SOURCES), SOURCES), one_hot(F.coalesce(size, F.lit(SIZES - 1)), SIZES))


class Logistic:
    """Ridge logistic regression on standardised columns by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        penalty = np.diag([ridge] * x.shape[1] + [1e-3])
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ self.w)
            self.w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)

    def linear(self) -> tuple[list[float], float]:
        """Weights on raw columns and the constant."""
        w = self.w[:-1] / self.scale
        return w.tolist(), float(self.w[-1] - w @ self.mean)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], held: np.ndarray) -> tuple[Logistic, Logistic, Logistic]:
    """Both views' models and the model that combines their calibrated logits.

    In each round a view labels the rows of the pool of which it is surest, as many of each class as the classes' shares say, and hands them to the other view.
    Calibration and combination are fitted on the held-out rows, which neither view has seen.
    """
    sets = [[v[~held], y[~held]] for v in views]
    free = np.arange(len(pool[0]))
    share = float(y[~held].mean()) if (~held).any() else 0.5
    models = [Logistic(*s) for s in sets]
    for _ in range(ROUNDS):
        given: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in (0, 1):
            p = 1 / (1 + np.exp(-models[k].logit(pool[k][free])))
            order = np.argsort(p, kind="stable")
            low, high = order[: round(PER_ROUND * (1 - share))], order[::-1][: round(PER_ROUND * share)]
            low, high = low[p[low] <= 1 - CONFIDENT], high[p[high] >= CONFIDENT]
            given[1 - k] = free[np.concatenate([low, high])], np.concatenate([np.zeros(len(low)), np.ones(len(high))])
        for k, (rows, labels) in given.items():
            sets[k] = [np.vstack([sets[k][0], pool[k][rows]]), np.concatenate([sets[k][1], labels])]
        used = np.concatenate([rows for rows, _ in given.values()])
        free = np.setdiff1d(free, used)
        models = [Logistic(*s) for s in sets]
        if not len(used):
            break
    calibrate = held if held.any() else ~held
    logits = np.column_stack([m.logit(v[calibrate]) for m, v in zip(models, views, strict=True)])
    return models[0], models[1], Logistic(logits, y[calibrate])


def _sample(rows: DataFrame, columns: list[str], bound: int) -> pa.Table:
    """At most ``bound`` rows, those with the smallest hashes of their identifiers. A first cut at the hash that leaves about as many keeps what
    partitions send to the driver small, however many there are."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    n = rows.count()
    cut = rows if n <= bound else rows.filter(h < int((1 << 40) * bound / n))
    return cut.orderBy(h, "doc_id", *[c for c in columns if c == "y"]).limit(bound).select(*columns).toArrow()


def _matrix(table: pa.Table, column: str, width: int | None = None) -> np.ndarray:
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, width or len(flat) // table.num_rows)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of good quality of every document by two views: doc_id, p_text, p_page, p_quality and kept (p_quality >= threshold).

    Text features read the whole text once; page features are language, source and size. Models are fitted on the driver on at most ``LABELLED`` labelled and
    ``POOL`` unlabelled rows, those with the smallest hashes of their identifiers; every document is then scored by expressions over its features.

    NULL texts count as empty, NULL metadata has its own bucket, rows with a NULL identifier are scored but never used to fit. Labels with a NULL are
    ignored; repeated ones count each. Without labels every probability is one half and every document is kept. An empty table gives none.
    """
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _page_view().alias("page"))
    seen = persist_table(fields.mapInArrow(_text_views, "doc_id long, page array<double>, words array<double>"))
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("y"))
    rows = seen.join(known, F.col("doc_id") == F.col("label_id"))
    sample = _sample(rows, ["words", "page", "y"], LABELLED)
    unknown = seen.join(known, F.col("doc_id") == F.col("label_id"), "left_anti").filter(F.col("doc_id").isNotNull())
    pool = _sample(unknown, ["words", "page"], POOL)
    if not sample.num_rows:
        half = F.lit(0.5)
        return seen.select("doc_id", half.alias("p_text"), half.alias("p_page"), half.alias("p_quality"), (half >= threshold).alias("kept"))
    views = tuple(_matrix(sample, c) for c in ("words", "page"))
    free = tuple(_matrix(pool, c, v.shape[1]) for c, v in zip(("words", "page"), views, strict=True))
    held = np.arange(sample.num_rows) % HELD_OUT == 0
    text_model, page_model, both = co_train(views, sample["y"].to_numpy(), free, held)
    scored = seen.select("doc_id", _logit("words", text_model).alias("a"), _logit("page", page_model).alias("b"))
    (wa, wb), c = both.linear()
    chance = lambda x: 1 / (1 + F.exp(-x))
    p = chance(F.lit(wa) * F.col("a") + F.lit(wb) * F.col("b") + F.lit(c))
    return scored.select("doc_id", chance(F.col("a")).alias("p_text"), chance(F.col("b")).alias("p_page"), p.alias("p_quality"), (p >= threshold).alias("kept"))


def _logit(column: str, model: Logistic) -> Column:
    weights, constant = model.linear()
    value = sum((F.get(column, F.lit(i)) * w for i, w in enumerate(weights)), F.lit(constant))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))
