"""Secrets in text: candidates by pattern, false findings removed by a random forest."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evenkeel.llm.forest import Forest
from evenkeel.llm.shared import by_place

#: Runs long enough to be a key; those without a digit or a change of case within are words.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]*\Z|[A-Z]+\Z|[-_=+/]*\Z")
#: Values after a cue and = or :, of any characters but blanks; a quoted one ends with its quote.
_SIGN, _VALUE = re.compile("[=:]"), re.compile(r"""[=:>]{0,2}\s{0,3}(?:"([^\s"]{6,})|'([^\s']{6,})|([^\s"']\S{5,}))""")
_AFTER = re.compile(r"[^A-Za-z]{0,4}([A-Za-z]+)")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z]{0,4}\Z")
#: Words that announce a secret, and words that announce something else.
CUES = frozenset("password passwd pwd secret token key apikey api auth bearer credential credentials private access passphrase passcode vault".split())
OTHER_CUES = frozenset("sha commit hash checksum md5 digest uuid id build revision integrity version page ref doi isbn order".split())
_ANNOUNCES = re.compile(rf"""(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{"|".join(sorted(CUES))})["']?\s{{0,3}}\Z""")
_ANNOUNCED = re.compile(_ANNOUNCES.pattern[:-2] + r"""[=:]{1,3}>?\s{0,3}["']?\Z""")
_BLANKLESS = re.compile(r"\S+")
#: A cue in a sentence, a password in an address, and the two ends of a private key.
_SAID = re.compile(rf"""(?<![A-Za-z])(?i:{"|".join(sorted(CUES))})\s{{1,3}}(?:is|was)[:\s]\s{{0,3}}["']?(?=\S{{6}})""")
_IN_ADDRESS = re.compile(r"://[^\s:/@]{0,64}:([^\s:/@]{4,128})@(?=[A-Za-z0-9\[])")
_KEY_BEGINS, _KEY_ENDS = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----")
#: What stands before data that is no secret: inline images, public keys, and parameters of addresses.
_PUBLIC, _PARAMETER = re.compile(r"(?:base64,|ssh-(?:rsa|dss|ed25519) |ecdsa-\S{1,30} |-----BEGIN (?:PUBLIC KEY|CERTIFICATE)-----\s)\Z"), re.compile(r"[?&][A-Za-z_]{1,16}=\Z")
_CONSONANTS = re.compile("[b-df-hj-np-tv-xz]+")
#: Parts of which identifiers and paths are made.
DICTIONARY = ("configuration", "application", "controller", "component", "function", "document", "template", "resource", "manager", "service", "request", "example", "default", "package", "handler", "version", "context", "license", "general", "public", "images", "static", "assets", "module", "number", "string", "client", "server", "update", "create", "report", "test", "user", "data", "file", "name", "page", "view", "list", "node", "main", "util", "core", "http", "html", "path", "type", "item", "info", "src", "lib", "get", "set", "the", "and", "for")
_DICTIONARY = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
_PATHS = re.compile(r"(^|/)(tests?|docs?|examples?|fixtures?|vendor)(/|$)|\.(md|rst|lock|min\.js)$")
#: Labelled findings that the forest is trained on, and the share of its votes that confirms a finding.
TRAINED_ON, CONFIRMED = 5000, 0.5
MASK = "[SECRET]"


def _class(c: str) -> int:
    return 0 if c in "0123456789" else 1 if c in "abcdef" else 2 if "a" <= c <= "z" else 3 if c in "ABCDEF" else 4 if "A" <= c <= "Z" else 5


def features(value: str, before: str, path: str, after: str = "") -> list[float]:
    """Length, character transitions, dictionary coverage, path, letters, and what is before and after a candidate."""
    kinds = [_class(c) for c in value]
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1)
    digit_steps = sum((a == 0) != (b == 0) for a, b in zip(kinds, kinds[1:])) / (n - 1)
    rising = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / (n - 1)
    covered = sum(len(m[0]) for m in _DICTIONARY.finditer(value.lower())) / n
    cue = (m := _BEFORE.search(before)) and m[1].lower()
    next_word = (m := _AFTER.match(after)) and m[1].lower()
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    shares = [kinds.count(k) / n for k in range(6)]
    return [float(n), changes, digit_steps, rising, covered, entropy, *shares, float(cue in CUES), float(cue in OTHER_CUES), float(bool(_PATHS.search(path))), float(value.startswith(("AKIA", "ghp_", "sk-", "xox"))), float(value.count("-") == 4 and n == 36),
            float(bool(_ANNOUNCED.search(before))), max(map(len, _CONSONANTS.findall(value.lower())), default=0) / n, sum(map(value.lower().count, "aeiou")) / n, float(value[0] in "$<{[%(/" or "(" in value or "://" in value),
            float(next_word in CUES), float(next_word in OTHER_CUES), float(after[:1] in ("(", "[", ".")),
            float(before.endswith(":") and "://" in before and after[:1] == "@"), float(bool(_KEY_BEGINS.match(value))), float(bool(_SAID.search(before[-30:] + "xxxxxx", max(0, len(before[-30:]) - 20)) and before[-1:] in " \"'")), float(bool(_PUBLIC.search(before))), float(bool(_PARAMETER.search(before)))]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans, in order; one may hold others: an announced value and a long run in it are judged each for itself."""
    spans = {m.span() for m in _CANDIDATE.finditer(text) if not _WORDLIKE.match(m[0])}
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if _ANNOUNCES.search(text[max(0, at - 20) : at]) and (m := _VALUE.match(text, at + 1)):
            value = m[m.lastindex] if m.lastindex < 3 else m[3].rstrip(",;)]}>\"'")
            if len(value) >= 6:
                spans.add((m.start(m.lastindex), m.start(m.lastindex) + len(value)))
    for m in _SAID.finditer(text):
        value = _BLANKLESS.match(text, m.end())[0].rstrip(",;)]}>\"'.!?")
        if len(value) >= 6:
            spans.add((m.end(), m.end() + len(value)))
    spans |= {m.span(1) for m in _IN_ADDRESS.finditer(text)}
    begins = list(_KEY_BEGINS.finditer(text))
    ends = iter(_KEY_ENDS.finditer(text) if begins else ())
    end = next(ends, None)
    for m, later in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        while end and end.start() < m.end():
            end = next(ends, None)
        if end and end.end() <= later:
            spans.add((m.start(), end.end()))
    return sorted(spans)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def announced_value(rng: random.Random) -> tuple[str, str, int]:
    """(value, text before, 1 for a secret) of a made-up value after a cue: passwords and keys, or settings and prose."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(pick("bcdfghlmnprst", 1) + pick("aeiou", 1) + pick("lnrst", rng.randint(0, 1)) for _ in range(rng.randint(2, 3)))
    cue = rng.choice(sorted(CUES))
    before = rng.choice([f"{cue}=", f'{cue}="', f"{cue}: ", f"my_{cue} = '", f"{cue.upper()}=", f"the {cue} is ", f"our {cue} was "])
    if rng.random() < 0.5:
        start = rng.randrange(26)
        value = rng.choice([
            lambda: word().capitalize() + pick("0123456789", rng.randint(1, 4)) + pick(lower, rng.randint(0, 4)), lambda: word() + pick(".!@$:#%^&*?-_", 1) + word() + pick("0123456789", rng.randint(1, 3)),
            lambda: pick(lower + lower.upper() + "0123456789.!@$:#%^&*", rng.randint(8, 24)), lambda: pick(lower + "0123456789", rng.randint(8, 15)),
            lambda: pick(lower, rng.randint(10, 24)), lambda: pick(lower.upper(), rng.randint(10, 24)), lambda: (lower * 3)[start : start + rng.randint(10, 24)], lambda: (lower.upper() * 3)[start : start + rng.randint(10, 24)],
        ])()
        return value, before, 1
    part = lambda: rng.choice(DICTIONARY)
    value = rng.choice([
        lambda: word(), lambda: word() + rng.choice([".", "!", "?", ""]), lambda: word().capitalize(), lambda: part() + "." + part(), lambda: part() + "_" + part(), lambda: part() + "." + part() + "()", lambda: part() + part().capitalize() + part().capitalize(), lambda: "${" + part().upper() + "_" + cue.upper() + "}", lambda: f"<your-{cue}>", lambda: "/" + part() + "/" + part(), lambda: "https://" + word() + ".org/" + part(),
        lambda: rng.choice(["required", "optional", "undefined", "changed", "invalid", "string", "default", "enabled", "disabled", "missing", "expired", "******", "xxxxxxxx"]),
    ])()
    return (value if len(value) >= 6 else value + "ation"), before, 0


def labelled_finding(rng: random.Random) -> tuple[str, str, str, int, str]:
    """(value, text before, path, 1 for a secret, text after) of one made-up finding."""
    if rng.random() < 0.12:
        return _framed_finding(rng)
    value, before, path, secret = _finding(rng)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    after = rng.choice(["", "\n", " " + word, '"', "';", '",', ", " + word, ". " + word.capitalize()])
    if not secret and rng.random() < 0.4:
        after = rng.choice([" " + rng.choice(sorted(OTHER_CUES)), " (" + rng.choice(sorted(OTHER_CUES)) + ")", "(" + word, ".get(", "[0]"])
    return value, before, path, secret, after


def _framed_finding(rng: random.Random) -> tuple[str, str, str, int, str]:
    """Passwords in addresses and private keys; inline images, public keys and parameters of addresses."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    base64s = lower + lower.upper() + digits + "+/"
    path = rng.choice(["src/app.py", "conf/prod.env", "README.md", "", "web"])
    scheme = rng.choice(["postgres", "mysql", "redis", "amqp", "https", "mongodb+srv", "ftp"])
    body = pick(base64s, rng.randint(60, 300))
    kind = rng.choice(["RSA ", "EC ", "", "OPENSSH ", "DSA "])
    return rng.choice([
        lambda: (pick(base64s[:62] + "!$%-_", rng.randint(6, 20)), f"{scheme}://{pick(lower, rng.randint(3, 8))}:", path, 1, "@" + pick(lower, 5)),
        lambda: (pick(lower, rng.randint(4, 6)) + pick(digits, rng.randint(1, 4)), f"url = {scheme}://{pick(lower, 5)}:", path, 1, "@db." + pick(lower, 4)),
        lambda: (f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", rng.choice(["", "\n", "key:\n"]), path, 1, rng.choice(["", "\n"])),
        lambda: (body, f"src=\"data:image/{rng.choice(['png', 'jpeg', 'gif'])};base64,", path, 0, '"'),
        lambda: ("AAAAB3NzaC1yc2EAAAADAQAB" + body, rng.choice(["ssh-rsa ", "\nssh-ed25519 "]), path, 0, " " + pick(lower, 5) + "@host"),
        lambda: (pick(base64s[:62] + "-_", rng.randint(16, 34)), f"https://{pick(lower, 6)}.org/{pick(lower, 5)}?{rng.choice(['list', 'v', 'id', 'sid', 'utm_id'])}=", path, 0, rng.choice(["", "&x=1", " "])),
        lambda: (body[:64], "-----BEGIN PUBLIC KEY-----\n", path, 0, "\n"),
    ])()


def _finding(rng: random.Random) -> tuple[str, str, str, int]:
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes, upper, digits = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789"
    base64s = upper + "abcdefghijklmnopqrstuvwxyz0123456789+/"
    if rng.random() < 0.4:
        value, before, secret = announced_value(rng)
        return value, before, rng.choice(["src/app.py", "src3", "conf/prod.env", "README.md", "tests/data.py", "", "web"]), secret
    cue, other = rng.choice(sorted(CUES)), rng.choice(sorted(OTHER_CUES))
    word = pick("etaoinshrdlu", rng.randint(2, 8))
    path = rng.choice(["src/app.py", "src3", "conf/prod.env", "README.md", "tests/data.py", "", "web"])
    if rng.random() < 0.5:
        value = rng.choice([lambda: "AKIA" + pick(upper + digits, 16), lambda: pick(hexes, rng.choice([16, 18, 24, 32, 40, 64])), lambda: pick(base64s, rng.choice([20, 32, 40, 44])), lambda: "ghp_" + pick(base64s[:62], 36), lambda: "sk-" + pick(base64s[:62], 32)])()
        announced = value.startswith(("AKIA", "ghp_", "sk-")) and rng.random() < 0.8
        return value, word + " " if announced else rng.choice([f"{cue}=", f'{cue} = "', f"{cue}: ", f"my_{cue}='"]), path, 1
    parts = [rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6))]
    value = rng.choice([
        lambda: "".join(p.capitalize() for p in parts) + pick(digits, 1), lambda: "_".join(parts) + pick(digits, 2), lambda: "/".join(parts) + "/" + pick(digits, 2), lambda: pick(digits, rng.randint(16, 20)),
        lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: pick(digits, 1) * rng.randint(16, 40), lambda: "-".join(parts) + "-2024-01-" + pick(digits, 2), lambda: "".join(pick("aeiou", 1) + pick("nrstl", 1) for _ in range(9)).capitalize() + "Xa" + pick("aeiou", 3),
    ])()
    plain = rng.choice([f"{word} ", f"{other} ", f"{other}: ", f"{word}, "]) if not re.fullmatch("[0-9a-f]{32,}", value) else rng.choice([f"{other} ", f"{other}: ", f"{other}="])
    return (value + "0" * 16)[: max(16, len(value))], plain, path, 0


@lru_cache(maxsize=1)
def trained_forest(seed: int = 5) -> Forest:
    rng = random.Random(seed)
    rows = [labelled_finding(rng) for _ in range(TRAINED_ON)]
    return Forest(seed=seed).fit(np.array([features(*r[:3], r[4]) for r in rows]), np.array([r[3] for r in rows]))


def find(texts: list[str], paths: list[str], forest: Forest) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of candidates, confirmed spans) of each text."""
    found = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t)]
    out: list[tuple[int, list[tuple[int, int]]]] = [(0, []) for _ in texts]
    if found:
        votes = forest.predict(np.array([features(texts[i][a:b], texts[i][max(0, a - 40) : a], paths[i], texts[i][b : b + 40]) for i, a, b in found]))
        for (i, a, b), vote in zip(found, votes):
            out[i] = (out[i][0] + 1, out[i][1] + [(a, b)] if vote >= CONFIRMED else out[i][1])
    return [(n, joined(spans)) for n, spans in out]


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in reversed(spans):
        text = text[:a] + MASK + text[b:]
    return text


def scan(df: DataFrame, text: str, path: str, into: str = "secret_scan") -> DataFrame:
    """df with the struct column ``into``: candidates, secrets, spans ("start:end", comma-joined) and masked, the text with secrets masked.

    Whole texts are read; null ones have no secrets and stay null, a null path is empty. Rows are scanned
    one by one, so ties, repeats and nulls elsewhere change nothing; a column of df named ``into`` is replaced; an empty
    df stays empty. The forest is trained once in the driver on TRAINED_ON labelled findings.
    """
    df = df.drop(into)
    sent = df.sparkSession.sparkContext.broadcast(trained_forest())
    made = StructType([StructField("candidates", LongType()), StructField("secrets", LongType()), StructField("spans", StringType()), StructField("masked", StringType())])
    schema = StructType([*df.schema, StructField(into, made)])
    text_at, path_at = df.columns.index(text), df.columns.index(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(text_at).to_pylist()
                found = find([t or "" for t in texts], [p or "" for p in part.column(path_at).to_pylist()], sent.value)
                new = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in s) for _, s in found], pa.string()), pa.array([t and masked(t, s) for t, (_, s) in zip(texts, found)], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(new, names=made.names)], names=schema.names)

    return by_place(df).mapInArrow(rows, schema)
