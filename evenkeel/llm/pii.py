"""Personal data: fixed patterns, and spans that a character-level BiLSTM-CRF adds to them."""

from __future__ import annotations

import hashlib
import inspect
import ipaddress
import random
import re
import string
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evenkeel.llm import lstm_crf
from evenkeel.llm.lstm_crf import LstmCrf
from evenkeel.llm.shared import kept_arrays

KINDS = ("email", "ip", "card", "phone")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match never starts within a run of digits; the look behind keeps a long run linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]")
_BLANK = re.compile(r"\s")
#: What each kind has: a digit, an @, an "at" in brackets, or one between words of which the second goes on with "dot".
_TRIGGER = re.compile(r"[0-9@]+|[(\[{]\s?[aA][tT]\s?[)\]}]|(?<=\w)\s[aA][tT]\s(?=[\w-]{1,40}\s[dD][oO][tT]\s\w)")
#: Characters of a window, by which the next one begins later, and around a trigger's blank-free run that are read.
WINDOW, STEP, AROUND = 64, 32, 32
#: Labelled windows that the model is trained on, and passes over them.
TRAINED_ON, EPOCHS = 3500, 15
#: Mean lead of a span's label over "no label", in the averaged emissions, below which it is not added.
LEAD = 1.0
_PUNCTUATION = "@.+-() ,:;=/\"'_%#\n[]{}<>*&$!?|"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would find them, but in one pass: all starts before an @ succeed or fail together."""
    end, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _EMAIL_RIGHT.match(text, at + 1)):
            end = m.end()
            yield left, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; failing matches are dropped without a retry."""
    if not _DIGIT_OR_AT.search(text):
        return []
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [("email", *x) for x in _emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_is_byte, m[0].split(".")))]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return spans


def _is_byte(part: str) -> bool:
    """Whether ASCII digits, of any number, are at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Codes of the characters below 0x3000: padding 0, digits 1, other letters 2, others 3, punctuation, then A-Z and a-z."""
    of = {c: i + 4 for i, c in enumerate(_PUNCTUATION + string.ascii_letters)}
    return np.array([1 if chr(c) in string.digits else of.get(chr(c), 2 if chr(c).isalpha() else 3) for c in range(0x3000)], np.int64)


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x3000, _codes()[np.minimum(points, 0x2FFF)], 2)


#: Plain words of four languages among which labelled spans stand, and words that go before personal data and before other numbers.
_PLAIN = (
    "the of and to in that was for with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know "
    "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für man aber aus durch wenn nur war noch werden bei hat wir was wird sein einen welche sind oder zur um haben einer mir über ihm diese einem ihr uns da zum kann doch vor dieser mich ihn du hatte seine mehr am denn nun unter sehr selbst schon hier bis habe ihre dann "
    "le la les de un une et est que pour dans ce qui pas sur plus ne se avec par au je il elle nous vous ils mais ou si leur son sa ses tout comme bien fait été même aussi deux encore peut sans être où très après avant "
    "el los las del y en que es por con para una su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos"
).split()
_CONTACT = {
    1: ["mail", "e-mail", "Email:", "write to", "contact", "schreib an", "courriel :", "correo:", "reach her at", "From:", "an", "to"],
    2: ["IP", "host", "server", "from", "address", "address:", "ping", "Rechner", "adresse", "client"],
    3: ["card", "card number", "Karte", "carte", "tarjeta", "Visa", "paid with", "charge", "credit card:", "Amex"],
    4: ["call", "tel.", "Tel:", "phone", "phone:", "Telefon", "mobile", "fax", "appelez le", "llame al", "cell", "ring us on", "text me at", "dial"],
    0: ["on", "No.", "page", "room", "order", "in", "since", "about", "chapter", "vol.", "ISBN", "version", "EUR", "$", "at", "line", "Seite", "ticket", "invoice", "order no.", "case", "population", "from", "total", "tracking", "build", "commit", "ratio"],
}


def labelled_window(rng: random.Random) -> tuple[str, list[int]]:
    """A window of made-up text with labelled spans, among numbers that are no personal data."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits = lambda n: pick(string.digits, n)
    hexes = lambda n: pick("0123456789abcdef", n)
    made_up = lambda: pick("abcdefghijklmnoprstuvéüñz", rng.randint(2, 9))
    name = lambda: rng.choice([made_up, lambda: pick("abcdefghijklmnoprstuvwyz", rng.randint(2, 10))])()
    word = lambda: rng.choice(_PLAIN) if rng.random() < 0.7 else made_up()

    def email() -> str:
        local = rng.choice([name(), f"{name()}.{name()}", f"{name()}_{digits(2)}", f"{name()}+{name()}", f"{made_up()}.{digits(2)}"])
        ending = rng.choice(["example.com", "org", "de", "example.net", "fr", "es", "co.uk", "info"])
        host = rng.choice([f"{name()}.{ending}", f"{name()}{digits(1)}.{ending}", f"{name()}-{name()}.{ending}"])
        if rng.random() < 0.3:
            a, b = rng.choice(["()", "[]", "{}"])
            at = f"{a}{rng.choice(['at', 'AT'])}{b}"
            space = rng.choice(["", " "])
            if rng.random() < 0.4:
                return f"{local} at {host}".replace(".", " dot ")
            return f"{local}{space}{at}{space}" + (host if rng.random() < 0.5 else host.replace(".", f" {a}dot{b} "))
        return f"{local}@{host}"

    def ip() -> str:
        if rng.random() < 0.5:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        groups = [hexes(rng.randint(1, 4)) for _ in range(8)]
        if rng.random() < 0.6:
            return ":".join(groups[: (k := rng.randint(1, 4))]) + "::" + ":".join(groups[k : k + rng.randint(1, 3)])
        return ":".join(groups)

    def card() -> str:
        n = rng.choice([13, 14, 15, 15, 15, 16, 16, 16, 19])
        body = rng.choice("3456") + digits(n - 2)
        body += next(d for d in string.digits if luhn(body + d))
        cuts = {15: (4, 10), 14: (4, 10)}.get(n, tuple(range(4, n, 4)))
        return rng.choice(["", " ", "-", ".", "  ", " ", "."]).join(body[a:b] for a, b in zip((0, *cuts), (*cuts, n)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([
            f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {digits(7)}", f"+{digits(11)}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)} {digits(4)} {c}", f"0{digits(2)}/{digits(7)}", f"(0{digits(2)}) {digits(4)} {c}",
            f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(1)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"00{digits(2)} {digits(2)} {digits(6)}", f"00{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"0{digits(3)}-{digits(6)}", f"{b}-{c}", f"9{digits(2)} {b} {a}", f"1-{a}-{b}-{c}",
        ])

    def other() -> str:
        year = f"{rng.choice(['19', '20'])}{digits(2)}"
        return rng.choice([
            f"{digits(1)}.{digits(1)}", digits(rng.randint(1, 8)), f"password={hexes(18)}", f'token = "{hexes(24)}"', f"AKIA{digits(3)}{pick('ABCDEFGHIJ', 5)}{digits(4)}", f"{year}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{year}", f"{digits(2)}/{digits(2)}/{year}", f"{year}-{year}", year,
            f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"BY-NC {digits(1)}.0", digits(24), digits(16), f"{digits(16)} " * 2, f"{digits(3)}.{digits(2)}", f"{digits(3)}-{digits(3)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(1)}.{digits(3)},{digits(2)}", f"{digits(1)} {digits(3)} {digits(3)}",
            f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(2)}.{digits(4)}, {digits(2)}.{digits(4)}", f"@{name()}", f"{digits(1)} @ {digits(1)}.{digits(2)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", hexes(40), f"#{digits(5)}", f"{digits(2)}%", f"{digits(1)}:{digits(1)}", f"§ {digits(3)}", f"{digits(4)}-{digits(6)}-{digits(5)}", f"INV-{year}-{digits(4)}", f"{pick('ABCDEFG', 2)}{digits(6)}", f"(at)  {digits(2)}",
        ])

    made = {1: email, 2: ip, 3: card, 4: phone, 0: other}
    text, labels = "", []

    def add(part: str, label: int = 0) -> None:
        nonlocal text
        text += part
        labels.extend([label] * len(part))

    while len(text) < 2 * WINDOW:
        if rng.random() < 0.4:
            kind = rng.choice([0, 0, 0, 0, 1, 2, 3, 3, 4, 4, 4])
            if rng.random() < 0.7:
                add(rng.choice(_CONTACT[kind]) + " ")
            open_, close = rng.choice([("", "")] * 6 + [("(", ")"), ('"', '"'), ("<", ">")])
            add(open_)
            add(made[kind](), kind)
            add(close)
        else:
            w = word()
            add(w.capitalize() if rng.random() < 0.15 else w)
        add(rng.choice([" ", " ", " ", " ", " ", ". ", ", ", "\n", "; ", " - ", ": "]))
    at = rng.randint(0, len(text) - WINDOW)
    end = at + (WINDOW if rng.random() < 0.75 else rng.randint(WINDOW // 4, WINDOW))  # some texts end within a window
    return text[at:end], labels[at:end]


def padded(codes: Sequence[int]) -> np.ndarray:
    return np.pad(np.asarray(codes, np.int64), (0, WINDOW - len(codes)))


@lru_cache(maxsize=1)
def trained_model(seed: int = 11) -> LstmCrf:
    model = _network(seed)
    model.fit(*_training(seed), EPOCHS)
    return model


def _network(seed: int) -> LstmCrf:
    return LstmCrf(4 + len(_PUNCTUATION) + 52, 1 + len(KINDS), 16, 32, seed, np.float32)


def _training(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of the made-up windows."""
    rng = random.Random(seed)
    rows = [labelled_window(rng) for _ in range(TRAINED_ON)]
    return np.stack([padded(encode(t)) for t, _ in rows]), np.stack([padded(y) for _, y in rows])


def kept_model(spark: SparkSession, seed: int = 11) -> LstmCrf:
    """The trained model, from the shared folder where a session before has left it: under a hash of the windows, the network and its code."""
    codes, labels = _training(seed)
    parts = (codes.tobytes(), labels.tobytes(), repr((seed, EPOCHS, TRAINED_ON, np.__version__)).encode(), inspect.getsource(lstm_crf).encode())
    model = _network(seed)
    model.p = kept_arrays(spark, f"pii-{hashlib.sha256(b'|'.join(parts)).hexdigest()[:32]}", lambda: trained_model(seed).p)
    return model


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches without which no kind is possible: the blank-free run around each trigger, of any length, and AROUND characters more."""
    out: list[list[int]] = []
    run_end = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < run_end:
            continue
        a, floor = m.start(), run_end
        while a > floor and not text[a - 1].isspace():
            a -= 1
        blank = _BLANK.search(text, m.end())
        run_end = blank.start() if blank else len(text)
        a, b = max(0, a - AROUND), min(len(text), run_end + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def model_spans(texts: list[str], model: LstmCrf, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans that the model finds. Windows overlap; a character's emissions are averaged over its windows, weighted
    by the distance to their edges, and each region is then decoded as a whole, so windows can't disagree."""
    regions = [(i, a, b) for i, text in enumerate(texts) for a, b in _regions(text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)
    windows = [(r, s) for r, (_, a, b) in enumerate(regions) for s in range(0, max(1, b - a - WINDOW + STEP), STEP)]
    sums: dict[int, np.ndarray] = {}
    for at in range(0, len(windows), batch):
        part = windows[at : at + batch]
        codes = np.zeros((WINDOW, len(part)), np.int64)
        for k, (r, s) in enumerate(part):
            i, a, b = regions[r]
            c = encode(texts[i][a + s : min(b, a + s + WINDOW)])
            codes[: len(c), k] = c
        e = model.emissions(codes)
        for k, (r, s) in enumerate(part):
            n = regions[r][2] - regions[r][1]
            total = sums.setdefault(r, np.zeros((n, e.shape[2] + 1)))
            m = min(WINDOW, n - s)
            total[s : s + m, :-1] += e[:m, k] * weight[:m]
            total[s : s + m, -1:] += weight[:m]
        done = part[-1][0] if at + batch < len(windows) else len(regions)
        for r in [r for r in sums if r < done]:
            total = sums.pop(r)
            mean = total[:, :-1] / total[:, -1:]
            path = model.decode(mean)
            i, a, _ = regions[r]
            for start, end in zip(edges := np.flatnonzero(np.diff(np.r_[-1, path, -1])), edges[1:]):
                label = path[start]
                if label and (mean[start:end, label] - mean[start:end, 0]).mean() >= LEAD:
                    out[i].append((KINDS[label - 1], a + int(start), a + int(end)))
    return out


_AT = re.compile(r"@|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s", re.I)
_DOT = re.compile(r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s", re.I)


def _plausible(kind: str, span: str) -> bool:
    """What an added span must look like: letters around an at, numbers with digits enough, a card with the right check digit."""
    if kind == "email":
        local, *host = _AT.split(_DOT.sub(".", span))
        return len(host) == 1 and bool(re.fullmatch(r"[^\s@]+", local)) and bool(re.fullmatch(r"[\w-]+(\.[\w-]+)+", host[0]))
    if kind == "ip":
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span):
            return all(map(_is_byte, span.split(".")))
        return bool(re.fullmatch(r"[0-9A-Fa-f:.]{3,45}", span)) and span.count(":") > 1 and _is_v6(span)
    digits = re.sub("[^0-9]", "", span)
    if any(c.isalnum() and c not in string.digits for c in span):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def _is_v6(span: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(span))
    except ValueError:
        return False


#: Characters that an added span doesn't begin and end with.
_LEFT, _RIGHT = " ,.;:\n-)<>\"'", " ,.;:\n-(+<>\"'"


def find(texts: list[str], model: LstmCrf) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Added spans are trimmed, plausible and clear of others, but for base spans of their kind that they widen."""
    out = []
    for text, found in zip(texts, model_spans(texts, model)):
        base = base_spans(text)
        spans = list(base)
        for kind, a, b in found:
            while a < b and text[a] in _LEFT:
                a += 1
            while a < b and text[b - 1] in _RIGHT:
                b -= 1
            if text[a:b].count(")") != text[a:b].count("("):
                a, b = (a, b - 1) if text[b - 1 : b] == ")" else (a + 1, b) if text[a : a + 1] == "(" else (a, b)
            edge = (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
            if a < b and not edge and _plausible(kind, text[a:b]) and all(b <= s or a >= e or (k == kind and a <= s and e <= b and (a, b) != (s, e)) for k, s, e in spans):
                spans.append((kind, a, b))
        out.append((base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of df: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Counts and hash are of the base spans; spans and n_spans are of all. Whole texts are read; null or empty ones have no
    spans and the hash of nothing. Rows are handled one by one: ties, repeats and other columns change
    nothing, a null key is kept, an empty df gives no rows. The model is trained in the driver on TRAINED_ON labelled windows, once
    for a shared folder.
    """
    sent = df.sparkSession.sparkContext.broadcast(kept_model(df.sparkSession))
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_spans", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = find([t.as_py() or "" for t in part.column(1)], sent.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                hashes = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(hashes, pa.string()), pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())], names=schema.names)

    return df.select(key, text).mapInArrow(rows, schema)
