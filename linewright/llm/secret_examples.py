"""Labelled findings that the forest of the secret scan is trained on, made from a seed.

Each example is a line of text with one value in it and whether the value is a secret. What makes it one is how it was made,
not what the scan measures: secrets are keys, tokens and passwords in code, settings, logs and prose; the others are what
such scans mistake for them: numbers of cards, phones and orders, digests and ids, versions, dates, paths, addresses, long
names, and placeholders where a secret would stand.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

SIZE = 1_600

#: Words that names, paths and sentences of the examples are made of.
WORDS = (
    "account address admin archive backup batch before between build cache client cloud cluster config connect container current data database default deploy "
    "device document download driver email engine error event example export feature field file filter folder format function gateway group handler header "
    "image import index input internal invoice item job key label layer library list local log mail main manager message method model module monitor name "
    "network node number object option order output package page parser path payment person platform policy print process product profile project query "
    "queue record region release report request response result return role router runtime sample schema script search section server service session "
    "setting stage start state storage stream string system table target task template test text thread time title token tool trace type update upload user "
    "value version video view volume web window worker"
).split()
SECRET_NAMES = "password passwd pwd secret token api_key apikey api-key access_key auth_token client_secret credential bearer".split()
KEY_NAMES = "key signing_key encryption_key master_key".split()
OTHER_NAMES = "commit sha256 md5 uuid checksum hash version revision build order invoice card phone tel isbn iban reference number".split()
ASSIGNED = (' = "{}"', "={}", ": {}", " = '{}'", '": "{}"', "='{}'", ": '{}'", " => \"{}\"", '="{}"')
PLACEHOLDERS = ("your_{}_here", "<{}>", "${{{}}}", "example_{}", "changeme_{}", "my-{}-value", "enter_{}_here", "replace_with_{}", "{{{{ {} }}}}", "xxxxxxxx{}", "os.environ.{}")

HEX, BASE64, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits


@dataclass(frozen=True)
class Example:
    text: str
    value: str
    label: int


def _drawn(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(least, most + 1)))


def _named(rng: random.Random, name: str) -> str:
    """A setting's name around the word that tells what it holds."""
    parts = [rng.choice(WORDS) for _ in range(rng.randrange(3))]
    at = rng.randrange(len(parts) + 1)
    full = rng.choice("_-.").join([*parts[:at], name, *parts[at:]])
    return rng.choice([full, full.upper(), full.title()])


def _words(rng: random.Random, least: int, most: int, between: str) -> str:
    return between.join(rng.choice(WORDS) for _ in range(rng.randrange(least, most + 1)))


def _secret(rng: random.Random) -> tuple[str, str]:
    """(value, what stands around it)"""
    value = rng.choice(
        [
            lambda: _drawn(rng, HEX, 32, 64),
            lambda: _drawn(rng, HEX, 32, 64).upper(),
            lambda: _drawn(rng, BASE64, 24, 64),
            lambda: _drawn(rng, ALNUM, 12, 40),
            lambda: _drawn(rng, ALNUM + "!@#%^&*?", 10, 24),
            lambda: _words(rng, 2, 5, rng.choice(["", "-", "_"])) + _drawn(rng, string.digits, 0, 4),
            lambda: _words(rng, 1, 2, "").title() + rng.choice("!@#$") + _drawn(rng, string.digits, 2, 5),
            lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(_drawn(rng, BASE64, 64, 64) for _ in range(rng.randrange(2, 12))) + "\n-----END RSA PRIVATE KEY-----",
            lambda: rng.choice(["AKIA", "ASIA"]) + _drawn(rng, string.ascii_uppercase + "234567", 16, 16),
            lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + _drawn(rng, ALNUM, 36, 40),
        ]
    )()
    known = value.startswith(("-----", "AKIA", "ASIA", "gh"))
    # a plain "key" is a secret's name only before something that looks drawn
    drawn = len(value) >= 16 and set(value) <= set(BASE64) and not set(value).isdisjoint(string.digits)
    names = SECRET_NAMES + KEY_NAMES if drawn else SECRET_NAMES
    around = _named(rng, rng.choice(names)) + rng.choice(ASSIGNED) if not known or rng.random() < 0.5 else rng.choice(["{}", "use {} for it", "\n{}\n"])
    return value, around


def _harmless(rng: random.Random) -> tuple[str, str]:
    digits = string.digits
    kind = rng.randrange(8)
    if kind == 0:
        return _drawn(rng, digits, 16, 19), rng.choice(["{}", "card {}", "paid with {} on", "number: {}", "{},", "token {}"])
    if kind == 1:
        return rng.choice([_drawn(rng, HEX, 40, 40), _drawn(rng, HEX, 64, 64), _drawn(rng, HEX, 32, 32)]), rng.choice([f"{rng.choice(OTHER_NAMES)} {{}}", f"{rng.choice(OTHER_NAMES)}: {{}}", f"{rng.choice(OTHER_NAMES)}={{}}", "fixed in commit {}"])
    if kind == 2:
        return "-".join(_drawn(rng, HEX, n, n) for n in (8, 4, 4, 4, 12)), rng.choice(["{}", "id={}", "uuid: {}", '"id": "{}"', "request {} failed"])
    if kind == 3:
        return f"20{_drawn(rng, digits, 2, 2)}-0{_drawn(rng, '123456789', 1, 1)}-1{_drawn(rng, digits, 1, 1)}T0{_drawn(rng, digits, 1, 1)}-1{_drawn(rng, digits, 1, 1)}-2{_drawn(rng, digits, 1, 1)}", rng.choice(["{}", "time={}", "from: {}", "log_{}"])
    if kind == 4:
        return "/" + _words(rng, 3, 7, "/") + _drawn(rng, digits, 1, 3), rng.choice(["{}", "path={}", "open {} and", "https://example.org{}", "file:{}"])
    if kind == 5:
        return _words(rng, 2, 5, rng.choice("_-")) + rng.choice("_-") + _drawn(rng, digits, 1, 4), rng.choice(["{}", "name={}", "import {}", "{}()", "stage: {}", "see {} there"])
    if kind == 6:
        return f"{rng.choice(WORDS)}-{_drawn(rng, digits, 1, 2)}.{_drawn(rng, digits, 1, 2)}".replace(".", "-") + "-" + _drawn(rng, digits, 8, 8), rng.choice(["version={}", "build: {}", "{}", "release {}"])
    name = rng.choice(SECRET_NAMES)
    return rng.choice(PLACEHOLDERS).format(rng.choice([name, name.upper(), rng.choice(WORDS)])), _named(rng, name) + rng.choice(ASSIGNED)


def examples(seed: int = 17, size: int = SIZE) -> list[Example]:
    """Half of them secrets."""
    rng = random.Random(seed)
    out = []
    for k in range(size):
        value, around = (_secret if k % 2 else _harmless)(rng)
        lead, tail = _words(rng, 0, 8, " "), _words(rng, 0, 8, " ")
        out.append(Example(f"{lead} {around.format(value)} {tail}".strip(), value, k % 2))
    return out
