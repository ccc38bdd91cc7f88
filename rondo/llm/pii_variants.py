"""Training examples for the personal-data field: ways of writing that the patterns miss, and strings that look alike but are none, in short carriers."""

from __future__ import annotations

import random
import re

#: Wording of the generated examples (fixed values).
TOPS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "nl", "eu", "co.uk"]
CARRIERS = {
    0: ["mail {}", "write to {} for details", "e-mail: {}", "contact {} or", "reach me under {}", "send it to {}, please", "address {}", "Email {} now", "my account is {}."],
    1: ["host {}", "server {} is down", "ip {}", "from {} port 80", "address {}", "connect to {} first", "login from {}.", "ping {}"],
    2: ["card {}", "credit card no. {}", "pay with {} today", "visa {}", "charged to {}", "card number: {}", "my card is {}."],
    3: ["call {}", "phone {}", "tel. {}", "Tel: {}", "fax {}", "mobile {} after six", "ring me at {}", "phone number is {}.", "whatsapp {}", "dial {} now"],
    4: ["on {}", "order {}", "version {}", "about {} of them", "dated {}", "no. {}", "id {}", "total {}", "release {}", "between {}", "isbn {}", "item {}", "see {}", "at {}", "serial {}", "build {} is out"],
}


def _word(rng: random.Random, low: int = 1, high: int = 4) -> str:
    return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(low, high)))


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _number(rng: random.Random, template: str) -> str:
    """Every 9 becomes a digit, the first of a run any but zero."""
    return re.sub("9+", lambda m: _digits(rng, len(m[0])), template)


def email(rng: random.Random) -> str:
    at = rng.choice([" at ", " at ", " at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", " @ ", "<at>", " {at} ", "@", " @", "@ ", " At "])
    words = at.strip(" <>(){}[]")
    dot = rng.choice([".", ".", " dot ", " dot ", f" {'DOT' if words == 'AT' else 'dot'} ", "(dot)", " (dot) ", "[dot]", " [dot] ", " . ", "[.]", " {dot} "])
    if at == "@" and dot == ".":
        dot = " dot "
    local = rng.choice(["{0}", "{0}.{1}", "{0}_{1}", "{0}-{1}", "{0}9", "{0}.{1}99"] + ["{0}" + dot + "{1}"] * 2)
    name = _number(rng, local.replace("{0}", _word(rng)).replace("{1}", _word(rng)))
    host = _word(rng) + rng.choice(["", "", "", "-" + _word(rng), dot + _word(rng)])
    text = name + at + host + dot + rng.choice(TOPS).replace(".", dot)
    return text.upper() if rng.random() < 0.08 else text


def ip(rng: random.Random) -> str:
    sep = rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", " [.] ", "{.}", ". "])
    return sep.join(str(rng.choice([rng.randint(0, 255), rng.choice([0, 1, 10, 127, 168, 192, 255])])) for _ in range(4))


def _checked(rng: random.Random, n: int, valid: bool) -> str:
    body = _digits(rng, n - 1)
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(body)))
    return body + str((-total + (0 if valid else rng.randint(1, 9))) % 10)


def _grouped(rng: random.Random, digits: str, seps: list[str]) -> str:
    cuts = (4, 10) if len(digits) == 15 else tuple(range(4, len(digits), 4))
    edges = [0, *cuts, len(digits)]
    return rng.choice(seps).join(digits[a:b] for a, b in zip(edges, edges[1:], strict=False))


def card(rng: random.Random) -> str:
    n = rng.choice([15, 15, 16, 16, 16, 19])
    return _grouped(rng, _checked(rng, n, True), [".", "/", "_", "  ", " - ", ". ", ":", "--"] + (["", " ", "-"] * 2 if n == 15 else []))


def phone(rng: random.Random) -> str:
    return _number(rng, rng.choice([
        "999-999-9999", "(999) 999-9999", "(999)999-9999", "999.999.9999", "999 999 9999", "1-999-999-9999", "1 (999) 999-9999", "0099 99 9999999", "0099 9 99 99 99 99", "0099-99-99999999",
        "09 99 99 99 99", "09.99.99.99.99", "099 9999 9999", "0999/9999999", "0999 / 999 999", "0999-999999", "099/99 99 99", "+9/999/999/9999", "+99 (0)99/999999", "+99/999/9999999", "+ 99 999 9999999",
        "+ 9 999 999 9999", "(0999) 999999", "(099) 9999 9999", "999/999-9999", "999 - 999 - 9999", "09999 999999", "9999999999",
    ]))


def lookalike(rng: random.Random) -> str:
    """A date, time, version, amount, list, identifier or plain sentence that is no personal data."""
    day, month, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1900, 2035)
    pick = rng.randrange(20)
    if pick == 0:
        return rng.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month:02}/{day:02}/{year}", f"{year}/{month:02}/{day:02}", f"{year}{month:02}{day:02}", f"{day} {month} {year}"])
    if pick == 1:
        return f"{year}-{month:02}-{day:02}{rng.choice(' T')}{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}" + rng.choice(["", ".123", "+00:00"])
    if pick == 2:
        return ".".join(str(rng.randint(0, 30)) for _ in range(3)) + rng.choice(["", ".0-beta", "-rc1"])
    if pick in (3, 4):  # four numbers, one too large for an address
        parts = [rng.randint(0, 255) for _ in range(4)]
        parts[rng.choice([0, 3, 3, rng.randrange(4)])] = rng.choice([256, rng.randint(256, 300), rng.randint(256, 999), rng.randint(1000, 20000)])
        return rng.choice([".", ".", " . ", "[.]"]).join(map(str, parts))
    if pick == 5:
        return _number(rng, rng.choice(["9,999,999.99", "999,999.99", "9 999 999", "99 999 999", "9.999.999,99", "$9,999,999", "99999999.99"]))
    if pick == 6:
        return _number(rng, rng.choice(["99999999", "999999999", "99999999999", "999-9999999-99", "99-9999-99999", "A99999999", "999999999999", "999999-99999999"]))
    if pick == 7:
        return _number(rng, rng.choice(["978-9-99-999999-9", "9789999999999", "978 9 9999 9999 9"]))
    if pick == 8:
        return rng.choice([f"{year}-{year + 6}, {year + 9}-{year + 12}", f"{year} and {year + 1}, {year + 2}", f"{year}, {year + 4}, {year + 8}", f"{year}-{year + 1}"])
    if pick == 9:
        return _number(rng, rng.choice(["99.9999, 99.9999", "9.99999999", "9.99999999999999", "0.99999999", "-99.999999 99.999999"]))
    if pick == 10:
        return rng.choice([" ", ", ", "; ", " / "]).join(str(rng.randint(0, 10 ** rng.randint(1, 4))) for _ in range(rng.randint(4, 9)))
    if pick in (11, 12):
        return _grouped(rng, _checked(rng, rng.choice([15, 16, 16]), False), [" ", "-", "", ".", "/"])
    if pick == 13:
        return f"{rng.randint(2, 90)} @ {rng.randint(1, 90)}.{rng.randint(0, 99):02}" + rng.choice(["", " each", f" and {rng.randint(100, 999)}"])
    if pick == 14:
        return f"@{_word(rng)}" + rng.choice([". ", " . "]) + _word(rng)
    if pick in (15, 16):  # sentences with "at" and a full stop
        return f"{_word(rng)} {_word(rng)} at {rng.choice([_word(rng), 'the ' + _word(rng), 'home', 'noon', '9'])}" + rng.choice([". ", ". ", " . ", ", "]) + f"{_word(rng).capitalize()} {_word(rng)}"
    if pick == 17:
        return f"{_word(rng)} at the {_word(rng)} dot {rng.choice(['on', 'in', 'of'])} the {_word(rng)}"
    if pick == 18:  # part of a longer name
        return "".join(rng.choice([_word(rng, 1, 1), _digits(rng, rng.randint(1, 11)), rng.choice("abcdef")]) for _ in range(rng.randint(2, 5))) + rng.choice("abcdef")
    return f"{rng.randint(1, 12)}:{rng.randint(0, 59):02}-{rng.randint(1, 12)}:{rng.randint(0, 59):02} {rng.choice(['and', '/', ','])} {rng.randint(100, 9999)}"


MAKERS = [email, ip, card, phone]


def example(rng: random.Random, prose: tuple[str, str]) -> tuple[str, tuple[int, int, int] | None]:
    """A text with one planted item, between a stretch of prose before and after it, and the item as kind, start, end (None for a lookalike)."""
    kind = rng.choice([0, 1, 2, 3, 3, 4, 4, 4, 4])
    item = lookalike(rng) if kind == 4 else MAKERS[kind](rng)
    bare = kind == 3 and item.isdigit()  # a plain run of digits is a number to call after a word that says so only
    carrier = "{}" if rng.random() < 0.4 and not bare else rng.choice(CARRIERS[kind])
    left, right = carrier.split("{}")
    text = f"{prose[0]} {left}" if prose[0] else left
    start = len(text)
    end = start + len(item)
    glue = rng.choice(["", "", ".", ",", ")", ";"]) if not right else ""
    return f"{text}{item}{right}{glue} {prose[1]}", None if kind == 4 else (kind, start, end)
