"""Personal data: fixed patterns, and a semi-Markov conditional random field that scores whole spans and adds what the patterns miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_variants import example

KINDS = ["email", "ip", "card", "phone"]
#: The patterns of the known kinds (fixed values), written so that each takes time in proportion to the text.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What an entity holds at least: an at sign, an international prefix, three close digits, an at or dot in brackets or spelled out.
TRIGGER = re.compile(
    r"@|\+\x20?[0-9]|[0-9][\x20.()/-]{0,2}[0-9]{2}|[\[({<]\x20?(?:[aA][tT]|[dD][oO][tT]|\.)\x20?[\])}>]|[0-9](?:\.\x20|\x20\.\x20|\x20[dD][oO][tT]\x20)[0-9]"
    r"|\b[aA][tT]\x20[A-Za-z0-9-]+(?:\.[A-Za-z]|(?:\x20[A-Za-z0-9-]+)?\x20(?:[dD][oO][tT]|\.)\x20[A-Za-z])"
)
BRACKETED = re.compile(r"\s*[\[({<]\s*(?:(at|@)|(?:dot|\.))\s*[\])}>]\s*", re.I)
SPELLED = re.compile(r"(?<=\s)(?:(at)|dot)(?=\s)", re.I)
BEFORE = re.compile(r"([A-Za-z]+|[0-9])[^A-Za-z0-9\n]*\Z")
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
MARGIN = 40  # characters of context on each side of a trigger in the training sample
MAX_TOKENS = 30  # of an entity
GAP = 3  # white space inside an entity, in characters
REACH = re.compile(r"(?:[A-Za-z]++|[0-9]++|[^\S\n]++|[^\n]){0,%d}+" % (MAX_TOKENS + 1))  # what an entity may add to a trigger; none crosses a line feed
WINDOW = 1_600  # characters labelled at a time, at first
TRAIN_REGIONS = 400  # bound of the training sample
EXAMPLES = 2_400  # generated ways of writing and lookalikes in the training sample
EPOCHS, RATE, DECAY = 3, 0.3, 1e-4
Span = tuple[int, int, int]  # kind, start, end


def _luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def known_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and non-overlapping per kind, failing ones dropped; by kind, then start."""
    spans, pos = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            spans.append((0, start, m.end()))
            pos = m.end()
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


def _behind(text: str, at: int, floor: int) -> int:
    """Start of the reach before ``at``, not before ``floor``."""
    size = 8 * MAX_TOKENS
    while True:
        low = max(floor, at - size)
        n = REACH.match(text[low:at][::-1]).end()
        if n < at - low or low == floor:
            return at - n
        size *= 2


def regions(text: str, known: list[Span] | None = None) -> list[tuple[int, int]]:
    """Stretches that hold every entity around a trigger whole: widened by the reach of ``MAX_TOKENS``, up to a line feed, and merged where they meet.

    Triggers inside a known span make none: an entity around them would overlap it.
    """
    found: list[tuple[int, int]] = []
    start = last = -1
    held = sorted((s, e) for _, s, e in known or [])
    k, covered = 0, -1
    for m in TRIGGER.finditer(text):
        while k < len(held) and held[k][0] <= m.start():
            covered = max(covered, held[k][1])
            k += 1
        if m.end() <= covered:
            continue
        if start >= 0 and not (m.start() - last <= MAX_TOKENS and text.find("\n", last, m.start()) < 0):
            end = REACH.match(text, last).end()
            if end < m.start() and (low := _behind(text, m.start(), end)) > end:
                found.append((start, end))
                start = low
        elif start < 0:
            start = _behind(text, m.start(), 0)
        last = m.end()
    return found + [(start, REACH.match(text, last).end())] * (start >= 0)


def sample_regions(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, merged where they meet up to a bound: pieces for the training sample, which may cut an entity."""
    found: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if found and start <= found[-1][1] and end - found[-1][0] <= 40 * MARGIN:
            found[-1] = (found[-1][0], end)
        else:
            found.append((max(start, found[-1][1]) if found else start, end))
    return found


def _side(c: str) -> str:
    return "e" if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c


def _features(text: str, start: int, end: int, before: str) -> list[str]:
    """Of a whole span: its shape, counts, numbers and neighbours; an at or dot that is bracketed or spelled out counts as the sign."""
    s = text[start:end]
    if "@" in s or LETTERS.search(s):
        plain = SPELLED.sub(lambda m: "@" if m[1] else ".", BRACKETED.sub(lambda m: "@" if m[1] else ".", s))
    else:
        plain = BRACKETED.sub(".", s) if "[" in s or "(.)" in s or "{" in s else s
    shape = LETTERS.sub("a", DIGITS.sub("9", plain))
    runs = DIGITS.findall(plain)
    digits = "".join(runs)
    out = [
        "bias", f"shape {shape[:40]}", f"digits {min(len(digits), 20)}", f"at {plain.count('@')}", f"dots {min(plain.count('.'), 4)}", f"runs {'-'.join(str(min(len(r), 5)) for r in runs[:6])}",
        f"first {_side(plain[0])}", f"last {_side(plain[-1])}", f"left {_side(text[start - 1 : start])}", f"right {_side(text[end : end + 1])}", f"letters {'a' in shape} {'@' in plain}", f"before {before}",
    ]
    out += [f"pair {p}" for p in {shape[i : i + 2] for i in range(min(len(shape), 40) - 1)}]
    if "@" in plain:
        top, low = plain.rsplit(".", 1)[-1].strip().lower()[:8], s.lower()
        signs = f"{'@' in s} {' dot ' in low} {' . ' in s} {any(c in s for c in '[(<{')}"
        out += [f"top {top}", f"signs {signs}", f"signs {signs} top {top}"]
    elif len(digits) >= 13:
        out.append(f"sum {_luhn(digits)}")
    elif len(runs) == 4:
        out.append(f"bytes {all(len(r) <= 3 and int(r) <= 255 for r in runs)} {'.' in plain}")
    if runs and "@" not in plain:
        out += [f"start {runs[0][:2] if runs[0][0] == '0' else runs[0][0]} {len(runs[0])}", f"size {len(digits)} {len(runs)}"]
    return out


class Lattice:
    """Tokens of a region and the entity spans worth scoring: up to ``MAX_TOKENS`` tokens on one line that can be an entity at all, without wider gaps than ``GAP``. These are
    numbers without letters of 7 to 19 digits, four numbers with dots, and stretches with one at and a dot after it."""

    def __init__(self, text: str, start: int, end: int):
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, start, end)]
        self.starts, self.ends = [t[0] for t in tokens], [t[1] for t in tokens]
        self.n = len(tokens)
        self.spans: list[list[tuple[int, list[str]]]] = [[] for _ in range(self.n + 1)]  # by end token: first token, features
        kinds = []
        for _, _, t in tokens:
            low = t.lower()
            kinds.append("9" if "0" <= t[0] <= "9" else "@" if low in ("@", "at") else "." if low in (".", "dot") else "\n" if "\n" in t else " " if t.isspace() else "a" if t.isalpha() else t)
        for i, (at, _, t) in enumerate(tokens):
            if kinds[i] not in "9a+(_" and not (kinds[i] in "@." and t.isalpha()):
                continue
            near = BEFORE.search(text, max(0, at - 24), at)  # a place's own, so that it is the same in every window
            before = "" if near is None else "9" if near[1].isdigit() else near[1].lower()[-12:]
            digits = runs = letters = ats = dots = after = 0
            for j in range(i, min(self.n, i + MAX_TOKENS)):
                kind = kinds[j]
                if kind == "\n" or kind == " " and tokens[j][1] - tokens[j][0] > GAP:
                    break
                if kind == "9":
                    digits, runs = digits + tokens[j][1] - tokens[j][0], runs + 1
                elif kind == "@":
                    ats, after = ats + 1, 0
                    if ats > 1 and "@" in tokens[j][2]:
                        break
                elif kind == ".":
                    dots, after = dots + 1, after + 1
                elif kind == "a":
                    letters += 1
                if kind == "9" and not letters and not ats:
                    fits = 7 <= digits <= 19 or runs == 4 and dots >= 3
                else:
                    fits = kind in "9a" and ats == 1 and after >= 1 and j > i
                if fits and tokens[j][1] - at >= 5:
                    self.spans[j + 1].append((i, _features(text, at, tokens[j][1], before)))


N = len(KINDS) + 1  # labels; the last one is outside
OUT = N - 1


class SemiMarkov:
    """Label sequence over segments: weights of (feature, kind) and of neighbouring labels. An outside segment is one token."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, moves: np.ndarray | None = None):
        self.weights = weights if weights is not None else {}
        self.moves = moves if moves is not None else np.zeros((N, N))

    def scores(self, features: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in features if f in self.weights), np.zeros(OUT))

    def _best(self, lattice: Lattice, first: int):
        """Scores of the best segments up to each token, by label of the last one, and the way back (Viterbi over segment ends) from the label ``first``."""
        best = np.full((lattice.n + 1, N), -np.inf)
        back: list[list[tuple[int, int] | None]] = [[None] * N for _ in range(lattice.n + 1)]
        best[0, first] = 0.0
        for j in range(1, lattice.n + 1):
            out = best[j - 1] + self.moves[:, OUT]
            best[j, OUT], back[j][OUT] = out.max(), (j - 1, int(out.argmax()))
            for i, features in lattice.spans[j]:
                through = best[i][:, None] + self.moves[:, :OUT]
                value = through.max(0) + self.scores(features)
                for y in np.flatnonzero(value > best[j, :OUT]):
                    best[j, y], back[j][y] = value[y], (i, int(through[:, y].argmax()))
        return best, back

    @staticmethod
    def _way(back: list, j: int, y: int) -> list[tuple[int, int, int]]:
        found = []
        while j > 0:
            i, before = back[j][y]
            if y != OUT:
                found.append((y, i, j))
            j, y = i, before
        return found[::-1]

    def decode(self, lattice: Lattice, first: int = OUT) -> list[tuple[int, int, int]]:
        """Best segments as kind, first token, end token."""
        best, back = self._best(lattice, first)
        return self._way(back, lattice.n, int(best[lattice.n].argmax()) if lattice.n else first)

    def segments(self, text: str, start: int, end: int) -> Iterator[Span]:
        """Best segments of a stretch of any length, the same as those of one lattice over it, as kind, start, end.

        The stretch is labelled window by window. A window's last token may be cut, so only the ways that end in the ``MAX_TOKENS`` tokens before it count, and
        every way through the whole stretch continues one of them. What they have in common is certain; the next window starts where they part.
        If they have nothing in common the window grows.
        """
        first, width = OUT, WINDOW
        while start + width < end:
            lattice = Lattice(text, start, start + width)
            best, back = self._best(lattice, first)
            ways = {(j, y) for j in range(max(0, lattice.n - 1 - MAX_TOKENS), lattice.n) for y in range(N) if best[j, y] > -np.inf}
            while len(ways) > 1:
                j, y = max(ways)
                ways.remove((j, y))
                ways.add(back[j][y])
            j, y = ways.pop()
            if j == 0:
                width *= 2
                continue
            yield from ((kind, lattice.starts[a], lattice.ends[b - 1]) for kind, a, b in self._way(back, j, y))
            start, first, width = lattice.ends[j - 1], y, WINDOW
        lattice = Lattice(text, start, end)
        yield from ((kind, lattice.starts[a], lattice.ends[b - 1]) for kind, a, b in self.decode(lattice, first))

    def gradient(self, lattice: Lattice, gold: set[tuple[int, int, int]]) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
        """Of the log-likelihood of the gold segments: counted minus expected features (forward and backward sums over segments)."""
        n, score = lattice.n, {}
        fwd, bwd = np.full((n + 1, N), -np.inf), np.full((n + 1, N), -np.inf)
        fwd[0, OUT] = 0.0
        for j in range(1, n + 1):
            fwd[j, OUT] = np.logaddexp.reduce(fwd[j - 1] + self.moves[:, OUT])
            for i, features in lattice.spans[j]:
                score[i, j] = self.scores(features)
                fwd[j, :OUT] = np.logaddexp(fwd[j, :OUT], np.logaddexp.reduce(fwd[i][:, None] + self.moves[:, :OUT], axis=0) + score[i, j])
        bwd[n] = 0.0
        for j in range(n, 0, -1):
            bwd[j - 1] = np.logaddexp(bwd[j - 1], self.moves[:, OUT] + bwd[j, OUT])
            for i, _ in lattice.spans[j]:
                bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(self.moves[:, :OUT] + (score[i, j] + bwd[j, :OUT])[None, :], axis=1))
        whole = np.logaddexp.reduce(fwd[n])
        by_feature: dict[str, np.ndarray] = {}
        moves = np.zeros((N, N))
        inside = {(i, j): y for y, i, j in gold}
        covered = [False] * n
        for i, j in inside:
            covered[i:j] = [True] * (j - i)
        if len(inside) != len(gold) or any((i, j) not in score for i, j in inside):
            return None
        before, j = OUT, 0
        while j < n:
            end = next((e for (s, e) in inside if s == j), None)
            y = inside[j, end] if end else OUT
            moves[before, y] += 1
            before, j = y, end or j + 1
        for j in range(1, n + 1):
            moves[:, OUT] -= np.exp(np.minimum(0, fwd[j - 1] + self.moves[:, OUT] + bwd[j, OUT] - whole))
            for i, features in lattice.spans[j]:
                p = np.exp(np.minimum(0, fwd[i][:, None] + self.moves[:, :OUT] + (score[i, j] + bwd[j, :OUT])[None, :] - whole))
                moves[:, :OUT] -= p
                g = -p.sum(0)
                if (i, j) in inside:
                    g[inside[i, j]] += 1
                if np.abs(g).max() > 1e-4:
                    for f in features:
                        by_feature[f] = by_feature.get(f, 0) + g
        return by_feature, moves


def train(samples: list[str], examples: int = EXAMPLES) -> SemiMarkov:
    """Fits the field by stochastic gradient steps with adaptive rates, on the sample, which the patterns label, and on generated examples set into prose of
    the sample: ways of writing that no pattern takes, and lookalikes. Without any sample the examples stand alone."""
    rng = random.Random(11)
    labelled = [(text, known_spans(text)) for text in samples]
    prose = [w for text, _ in labelled for w in text.split() if w.isalpha()] or ["the"]
    for _ in range(examples):
        sides = [" ".join(prose[k : k + rng.randint(0, 5)]) for k in (rng.randrange(len(prose)), rng.randrange(len(prose)))]
        text, planted = example(rng, (sides[0], sides[1]))
        own = [planted] if planted else []
        labelled.append((text, own + [k for k in known_spans(text) if not own or k[2] <= own[0][1] or own[0][2] <= k[1]]))
    model, seen = SemiMarkov(), {}
    square = np.full((N, N), 1e-2)
    lattices = []
    for text, spans in labelled:
        lattice = Lattice(text, 0, len(text))
        at, to = {s: i for i, s in enumerate(lattice.starts)}, {e: i + 1 for i, e in enumerate(lattice.ends)}
        gold = {(k, at[s], to[e]) for k, s, e in spans if s in at and e in to}
        if len(gold) == len(spans) and any(lattice.spans):
            lattices.append((lattice, gold))
    for _ in range(EPOCHS):
        rng.shuffle(lattices)
        for lattice, gold in lattices:
            step = model.gradient(lattice, gold)
            if step is None:
                continue
            for f, g in step[0].items():
                seen[f] = seen.get(f, 1e-2) + g * g
                model.weights[f] = model.weights.get(f, np.zeros(OUT)) * (1 - DECAY) + RATE * g / np.sqrt(seen[f])
            square += step[1] ** 2
            model.moves += RATE * step[1] / np.sqrt(square)
    return model


def added_spans(text: str, model: SemiMarkov, known: list[Span]) -> list[Span]:
    """Segments of the best labelling of each region that overlap no known span."""
    if not model.weights:
        return []
    taken = sorted((s, e) for _, s, e in known)
    starts, found = [s for s, _ in taken], []
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
    for start, end in regions(text, known):
        for kind, s, e in model.segments(text, start, end):
            k = int(np.searchsorted(starts, e))
            if k == 0 or reach[k - 1] <= s:
                found.append((kind, s, e))
    return found


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        texts = [t for t in rows.column("text").to_pylist() if t]
        yield pa.RecordBatch.from_arrays([pa.array([t[s:e] for t in texts for s, e in sample_regions(t)], pa.string())], ["region"])


def fit(docs: DataFrame, regions_kept: int = TRAIN_REGIONS) -> SemiMarkov:
    """Trains on at most ``regions_kept`` regions, those with the smallest hashes over all documents; only they reach the driver."""
    found = docs.select("text").mapInArrow(_regions_of, "region string").dropDuplicates(["region"])
    chosen = found.orderBy(F.xxhash64("region"), "region").limit(regions_kept)
    return train([r.region for r in chosen.collect()])


def find_personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """Personal data in every whole text: n_email, n_ip, n_card, n_phone of the patterns, the digest of their spans, and all spans.

    The field is fitted on a bounded sample and generated examples (``fit``, ``train``) unless one is given, and labels the stretches around triggers; the spans it finds beside the known
    ones are added. Spans are kind:start:end by kind, then start, in code points, end exclusive. NULL texts count as empty,
    NULL identifiers stay, repeated rows are searched each, an empty table gives none. Texts pass through one at a time.
    """
    field = model or fit(docs)
    weights, moves = field.weights, field.moves

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_field = SemiMarkov(weights, moves)
        for rows in batches:
            counts, digests, lists = [[] for _ in KINDS], [], []
            for t in rows.column("text"):
                text = t.as_py() or ""
                known = known_spans(text)
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[0] == k for s in known))
                digests.append(hashlib.sha256(_listed(known).encode()).hexdigest())
                lists.append(_listed(known + added_spans(text, known_field, known)))
            columns = [rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lists, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, {counted}, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with every listed span replaced by its kind in brackets; overlapping spans become one of the first one's kind."""
    out, pos = [], 0
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], -x[2])):
        if s >= pos:
            out += [text[pos:s], f"[{kind}]"]
        pos = max(pos, e)
    return "".join([*out, text[pos:]])
