"""Secret and personal-data scans against plain regular expressions, and what the methods add."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.llm.pii import KINDS, Lattice, SemiMarkov, added_spans, find_personal_data, fit, known_spans, redact, regions
from rondo.llm import secret_scan as secret_scan_module
from rondo.llm.secret_scan import secret_scan

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


PARTS = ["password", "PassWD", " = ", ":", '"', "'", "token", "AKIA", "ABCDEFGH12345678", "abcdef0123456789", "deadbeef" * 3, "é", "😀", " ", "\n", "x", "api_key", "secret: ", "Zm9vYmFyQ2x1ZUJhbTEyMzQ1"]


def test_known_secrets_match_brute_force(spark, odd):
    rng = random.Random(3)
    rows = [(10_000 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(600)] + [(9000, None), (9001, ""), (9002, "token=abcdef1 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    for r in secret_scan(docs).join(docs.distinct(), "doc_id").collect():
        want = secrets(r.text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("entropy")) == listed


def test_entropy_finds_random_strings_and_spares_plain_ones(spark, none):
    texts = [
        "see Kx8vQ2mZr7Lw1TbN5yHc and", "number 12345678901234567890123456", "word internationalizationandmore", "path usr/local/lib/python/site-packages",
        "id 123e4567-e89b-12d3-a456-426614174000", "key EXAMPLEx8vQ2mZr7Lw1TbN5yHc", "aaaaaaaaaaaaaaaaaaaaaa1", "token=Kx8vQ2mZr7Lw1TbN5yHc", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz0Kx8vQ2mZr7Lw1TbN5yHc",
    ]
    got = [r.spans for r in secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == "entropy:4:24" and got[1] == "hex:7:33" and got[2:7] == [""] * 5 and got[7] == "assign:0:26"
    start, end = map(int, got[8].split(":")[1:])
    assert got[8].startswith("entropy:") and start > 20 and end == 51
    assert secret_scan(none).count() == 0


def test_glued_text_does_not_hide_a_secret(spark):
    rng, secret = random.Random(8), "Kx8vQ2mZr7Lw1TbN5yHc"
    runs = ["".join(rng.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(300)]
    texts = [f"sig={r}" for r in runs] + [f"/srv/examples/data/{secret}", f"sample_{secret}", "id=123e4567-e89b-12d3-a456-426614174000", f"{secret}EXAMPLE"]
    got = [r.spans for r in secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert sum(x.startswith("entropy:") for x in got[:300]) >= 297
    assert all(x.startswith("entropy:") and x.endswith(f":{len(t)}") for x, t in zip(got[300:302], texts[300:302], strict=True)) and got[302:] == [""] * 2


def windows(text):
    """Stretches of hot windows by counting every window anew."""
    hot = []
    for k in range(len(text) - 19):
        w = text[k : k + 20]
        bits = -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 3.4 if re.fullmatch("[A-Z0-9]+", w) else 3.7
        if bits >= least - 1e-9:
            if hot and k <= hot[-1][1] + 20:
                hot[-1][1] = k
            else:
                hot.append([k, k])
    return [tuple(x) for x in hot]


@pytest.mark.parametrize("block", [7, 4096])
def test_windows_match_a_plain_count(spark, monkeypatch, block):
    monkeypatch.setattr(secret_scan_module, "BLOCK", block)
    rng = random.Random(block)
    parts = ["a" * 30, "ABCD1234", "0123456789abcdef", "Kx8vQ2mZr7Lw1TbN5yHc", "q", "Zz", "=", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 30))) for _ in range(150)]
    texts = [t for t in texts if len(t) >= 20]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", secret_scan_module._entropy_windows(F.col("t")).alias("w")).collect()
    assert {r.i: [(w.first, w.last) for w in r.w] for r in got} == {i: windows(t) for i, t in enumerate(texts)}


def test_long_paths_and_lists_do_not_crash(spark):
    """A million path segments, a dashed list, and a long run that no rule allows; a stack of frames a segment would end the process."""
    texts = ["a/" * 1_000_000 + "x", "Word-" * 200_000 + "end12", "a/" * 20_000 + "x1y" + "/b" * 20_000, "Kx8vQ2mZr7Lw1TbN5yHc" * 2_000]
    got = {r.doc_id: r.spans for r in secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == got[2] == "" and got[3] == "entropy:0:40000"


def test_letters_only_secrets_are_found(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(k, "key " + "".join(rng.choice(letters) for _ in range(40))) for k in range(300)]
    plain = ["getHttpResponseCodeFromServer", "InternationalizationServiceProvider", "some_long_identifier_with_words", "usr/Local/share/Documents", "ALLCAPITALLETTERSHERE"]
    rows += [(1000 + k, t) for k, t in enumerate(plain)]
    got = {r.doc_id: r.spans for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("entropy" in got[k] for k in range(300)) >= 285 and all(got[1000 + k] == "" for k in range(len(plain)))


PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def personal(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fails = {1: any(int(p) > 255 for p in m[0].split(".")) if kind == 1 else False, 2: not (16 <= len(digits) <= 19 and luhn(digits)), 3: not 8 <= len(digits) <= 15}
            if not fails.get(kind, False):
                found.append((kind, m.start(), m.end()))
    return found


def test_known_personal_data_matches_plain_patterns():
    rng = random.Random(4)
    parts = ["a", ".", "@", "b.c", "1", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "+1 (605) 555-9305", "é", "x@y.com", "%", "(", ")", "0", "\n"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert known_spans(text) == personal(text), text


@pytest.fixture(scope="module")
def field(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_recovers_known_spans_and_adds_near_ones(spark, field, none, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in find_personal_data(docs, field).join(docs.select("doc_id", "text"), "doc_id").collect():
        known = known_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in known).encode()).hexdigest()
        assert set(f"{KINDS[k]}:{s}:{e}" for k, s, e in known) <= set(r.spans.split(",")) | {""}
    text = "the the 4111 1111 1111 1111 of and +1 (605) 555-9305 190. or"
    row = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert "card:8:27" in row.spans and row.n_phone == 1 - ("+1 (605) 555-9305 190" in text and personal(text)[-1][0] != 3)
    assert find_personal_data(none, field).count() == 0
    assert find_personal_data(odd, field).count() == odd.count()
    assert find_personal_data(odd, SemiMarkov()).filter("doc_id = 1").first().n_email == 0


def test_held_out_labels(spark, field):
    """The field alone finds spans of regions it was not trained on."""
    from rondo.llm.pii import Lattice

    right = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 7 = 3 and text rlike '@|[+][0-9]'").collect():
        found = set()
        for s, e in regions(r.text):
            lattice = Lattice(r.text, s, e)
            found |= {(k, lattice.starts[i], lattice.ends[j - 1]) for k, i, j in field.decode(lattice)}
        known = set(known_spans(r.text))
        right, total = right + len(known & found), total + len(known)
    assert total > 20 and right > 0.9 * total


def dense_field():
    """A field that takes digits, a point and digits for a phone number and nothing else."""
    return SemiMarkov({"shape 9.9": np.array([0.0, 0.0, 0.0, 9.0]), "bias": np.full(4, -4.0)})


def test_added_spans_at_the_seams():
    rng = random.Random(6)
    for n in (30, 170, 600):
        entries = [f"{rng.randrange(10**4, 10**5)}.{rng.randrange(100, 1000)}" for _ in range(n)]
        for glue in (" ", "; ", "\n"):
            text = glue.join(entries)
            places = [(3, i * (9 + len(glue)), i * (9 + len(glue)) + 9) for i in range(n)]
            assert sorted(added_spans(text, dense_field(), [])) == places


def test_windows_give_the_labels_of_one_lattice(field):
    rng = random.Random(7)
    parts = ["555-0101", "1.2.3.4", "a@b.c", " ", " ", "-", "+1 ", "(605) ", "12", "abc", "4111 1111 1111 1111", ".", ","]
    text = "".join(rng.choice(parts) for _ in range(1500))
    (start, end), lattice = (0, len(text)), Lattice(text, 0, len(text))
    want = [(k, lattice.starts[i], lattice.ends[j - 1]) for k, i, j in field.decode(lattice)]
    assert want and list(field.segments(text, start, end)) == want


def test_regions_hold_entities_whole():
    mail = "a.very.long.name.of.somebody.who.writes@mail.host"
    for text in (f"{'word ' * 40}{mail} and {'word ' * 40}", f"x\n{mail}\ny", mail):
        at = text.index(mail)
        assert any(s <= at and at + len(mail) <= e for s, e in regions(text))
    assert regions("no trigger") == [] and regions("1" * 300_000) == [(0, 300_000)] and regions("a 123\nb 456") == [(0, 5), (6, 11)]


def written_otherwise(rng):
    """Ways of writing that the patterns miss, worded by hand and not by the generator of the training examples, with their kinds; and lookalikes."""
    d = lambda n: "".join(str(rng.randint(2, 9)) for _ in range(n))
    name, host = rng.choice(["john", "mary.jones", "anna_k", "r2sales", "office"]), rng.choice(["example", "mailbox", "uni-north", "acme"])
    at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT ")])
    body = d(15)
    number = next(body + c for c in "0123456789" if luhn(body + c))
    octets = [str(rng.randint(1, 255)) for _ in range(4)]
    found = [
        (0, f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'de'])}"), (1, rng.choice(["[.]", "(.)", " dot "]).join(octets)), (2, rng.choice([".", "/", "_"]).join(number[i : i + 4] for i in range(0, 16, 4))),
        (3, f"{d(3)}-{d(3)}-{d(4)}"), (3, f"({d(3)}) {d(3)}-{d(4)}"), (3, f"0049 {d(2)} {d(7)}"), (3, f"{d(3)}.{d(3)}.{d(4)}"), (3, f"0{d(3)}/{d(6)}"),
    ]
    wrong = next(body + c for c in "0123456789" if not luhn(body + c))
    return found, [
        "10.0.0.256", f"{rng.randint(1950, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"2.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(2)} at noon . Then",
        f"ab{d(9)}cd", f"{d(3)} or {d(3)} or {d(3)}", "-".join(wrong[i : i + 4] for i in range(0, 16, 4)), "look at the dot on the map", f"{d(1)}:{d(2)}",
    ]


def test_field_finds_what_patterns_miss(spark, field):
    """Recall and precision of the added spans on variants set between words of whole documents the field was not shown."""
    rng = random.Random(21)
    rows, planted = [], {}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 91 = 5 and length(text) between 200 and 4000").orderBy("doc_id").limit(60).collect()]
    for doc, text in enumerate(texts):
        clean = " ".join(w for w in text.split() if w.isalpha())
        out, want = clean[:60] + " ", set()
        found, plain = written_otherwise(rng)
        for kind, item in sorted([*found, *((None, p) for p in plain)], key=lambda x: rng.random()):
            if kind is not None:
                want.add(f"{KINDS[kind]}:{len(out)}:{len(out) + len(item)}")
            out += f"{item} {rng.choice(['and', 'so', 'see', 'the', 'is'])} {rng.choice(clean.split() or ['word'])} "
        assert known_spans(out) == []
        planted[doc] = want
        rows.append((doc, out))
    got = {r.doc_id: set(r.spans.split(",")) - {""} for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    hits, wanted, made = sum(len(got[d] & planted[d]) for d in planted), sum(map(len, planted.values())), sum(map(len, got.values()))
    assert wanted > 300 and hits >= 0.9 * wanted and hits >= 0.9 * made, (hits, wanted, made)


def test_field_takes_long_runs_in_linear_time(field):
    """Wide gaps, long words and long numbers beside a trigger; the entity after them is found all the same."""
    for filler in (" " * 200_000, "x" * 200_000, "7" * 200_000, "12 " * 3_000, "( " * 5_000, "at " * 5_000):
        text = f"a@ {filler} b.c and call 605-555-9305 now"
        started = time.time()
        spans = added_spans(text, field, known_spans(text))
        assert (3, len(text) - 16, len(text) - 4) in spans and time.time() - started < 20


def test_field_matches_enumeration(field):
    """The best labelling and the gradient's expected counts against every segmentation of a short text."""
    rng = random.Random(5)
    for text in ("a@b.c 12", "1.2.3.4 x", "555 0101", "a at b.c"):
        lattice = Lattice(text, 0, len(text))
        score = {(i, j): field.scores(f) for j in range(lattice.n + 1) for i, f in lattice.spans[j]}
        small = SemiMarkov({f: w / 8 for f, w in field.weights.items()}, field.moves / 8)
        for model, scale in ((field, 1.0), (small, 8.0)):
            whole = []

            def walk(at, last, total, found):
                if at == lattice.n:
                    whole.append((total, tuple(found)))
                    return
                walk(at + 1, len(KINDS), total + model.moves[last, len(KINDS)], found)
                for (i, j), s in score.items():
                    if i == at:
                        for y in range(len(KINDS)):
                            walk(j, y, total + model.moves[last, y] + s[y] / scale, [*found, (y, i, j)])

            walk(0, len(KINDS), 0.0, [])
            best = max(whole)
            assert abs(best[0] - max(t for t, f in whole if list(f) == model.decode(lattice))) < 1e-9
            gold = set(rng.choice(whole)[1])
            z = np.logaddexp.reduce([t for t, _ in whole])
            bias = np.zeros(len(KINDS))
            for t, f in whole:
                for y, _, _ in f:
                    bias[y] -= np.exp(t - z)
            for y, _, _ in gold:
                bias[y] += 1
            assert np.allclose(model.gradient(lattice, gold)[0].get("bias", 0), bias, atol=1e-3)


def test_redact():
    assert redact("mail a@b.c or 1.2.3.4", "email:5:10,ip:14:21") == "mail [email] or [ip]"
    assert redact("plain", "") == "plain"
