"""PII (operator 3): candidate spans, boosted trees, calibrated thresholds.

Base spans are found by the four patterns of the contract and are always kept.
High-recall generators propose further spans that may overlap: addresses with a
written-out at or dot, national phone numbers, card numbers with other
separators, IPv6 and defanged IPv4 addresses. Boosted trees judge each candidate
by its format and by the words and characters around it. Their margins are
calibrated on rows that the trees have not seen; a candidate is taken if its
probability reaches the threshold of its kind, the likelier one first where two
overlap, and never where a base span lies.

Training: the tables have no labelled spans, so the trees learn from ``train_rows``
sentences made from templates with a seed: personal data of each format in
running text, and look-alikes (order numbers, versions, times, prices, sites, years, ends of
sentences). The bound is a parameter; fitting takes about two seconds. Thresholds
are where an F measure that prefers precision is best on made sentences of another
seed and on sentences labelled by hand in four languages (pii_sentences).

Defined results: null and empty texts have no spans; offsets are code points,
end exclusive; repeated rows get a row each; other columns are ignored.

Every pattern runs in time linear in the text: digit runs and names are matched
once, from where they begin.

Scale: one pass over the documents, no shuffle; the model is a fixed few hundred
kilobytes whatever the input.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm.boosting import Boosted
from ledgerloom.llm.pii_sentences import SENTENCES

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The contract's spans: leftmost, non-overlapping within a kind; matches that fail a test are skipped whole."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # no local part reaches back over an @
        at = text.find("@", max(at + 1, end if m else 0))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out["phone"].append(m.span())
    return out


_AT = re.compile(r"[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]|\x20(?:at|AT)\x20|\x20@\x20|@\x20|\x20@")
_DOT = r"\x20?(?:[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]|\.|\x20(?:dot|DOT)\x20)\x20?"
_AFTER_AT = re.compile(rf"\x20?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.,-])[(]?[0-9][0-9().\x20/-]{5,28}[0-9](?![0-9A-Za-z])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?<![0-9][.,/_-])[0-9]{3,6}(?:[\x20.\xA0/_-]{0,2}[0-9]{2,7}){2,5}(?![0-9])")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything that may be personal data; spans may overlap."""
    out = []
    for m in _AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = end
        while start > 0 and text[start - 1] in _LOCAL:  # the whole name; two markers share none of it
            start -= 1
        right = _AFTER_AT.match(text, m.end()) if start < end else None
        if right:
            out.append(("email", start, right.end()))
    out += [("ip", *m.span()) for m in _IP6.finditer(text) if m.end() - m.start() > 4]
    out += [("ip", *m.span()) for m in _DEFANGED.finditer(text)]
    out += [("phone", *m.span()) for m in _NATIONAL.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    out += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text) if 12 <= len(_digits(m[0])) <= 19]
    return out


#: Cue words in four languages that stand near personal data, by kind, and near look-alikes.
CUES = {
    "email": ("mail", "e-mail", "email", "correo", "courriel", "write", "contact", "kontakt", "contacto", "reach"),
    "ip": ("ip", "host", "server", "address", "client", "peer", "adresse", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "pay", "cc"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "dial", "sms", "cell"),
    "other": ("order", "invoice", "version", "isbn", "id", "no", "ref", "page", "date", "item", "total", "price", "time", "serial", "ticket", "sku", "account"),
}
TLDS = frozenset("com org net edu gov io de fr es uk eu info biz co us me dev ai ch at it nl".split())


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = _digits(s)
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 32) : start].lower())[-4:]
    parts = re.split(r"[^0-9A-Za-z]+", s.lower())
    groups = re.findall(r"[0-9]+", s)
    years = sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    near = [float(any(w in CUES[k] for w in before)) for k in (*KINDS, "other")]
    return [
        float(KINDS.index(kind)), len(s), len(d), len(d) / max(1, len(s)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(d)) if d else 0.0, float(d[:1] in ("3", "4", "5", "6")), float(d[:1] == "0"), float("(" in s and ")" in s),
        s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count(":"), float("::" in s), len(set(d)) / max(1, len(d)), years,
        float("dot" in parts), float("at" in parts and ("(" in s or "[" in s or "{" in s or "<" in s)), float("@" in s), float(parts[-1] in TLDS), float(bool(re.search(r"\. ", s))),
        float(start == 0 or text[start - 1] in " \n\t(:<\"'"), float(text[end : end + 1] in " \n\t.,;)>\"'" or end == len(text)),
        float(text[start - 1 : start] in ("$", "#", "€")), float(text[end : end + 1] in ("%", "€", "$")), *near,
    ]


def _sentences(n: int, seed: int) -> list[tuple[str, list[tuple[str, str]]]]:
    """Made sentences with the (kind, value) that they hold; look-alikes have kind ''."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdmpkbgh") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice(("4", "51", "55", "37", "6011")) + num(12)
        d = d[:15]
        d = next(x for x in (d + c for c in "0123456789") if luhn(x))
        sep = r.choice((".", "/", "  ", "_", " ", " - "[:2]))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def year() -> str:
        return r.choice(("18", "19", "20")) + num(2)

    def no_card() -> str:
        d = num(16)
        while luhn(d):
            d = num(16)
        return r.choice((" ", ".", "-", "/")).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3).replace("0", "2"), num(3).replace("0", "5"), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"00{num(2).replace('0', '4')} {a} {b} {c}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{a} {b} {c}"))

    def email() -> str:
        at = r.choice((" (at) ", "(at)", " [at] ", "[at]", " at ", " AT ", " {at} ", " @ "))
        dot = r.choice((" (dot) ", " [dot] ", " dot ", " DOT ", "[dot]")) if at.strip().lower() == "at" or r.random() < 0.7 else "."
        return f"{word()}{r.choice(('', '.' + word(), num(2)))}{at}{word()}{dot}{r.choice(sorted(TLDS))}"

    def ip() -> str:
        if r.random() < 0.5:
            return ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if r.random() < 0.5 else f"{r.randrange(8192, 16384):x}:{r.randrange(65536):x}::{r.randrange(1, 65536):x}"
        return r.choice(("[.]", "(.)", "[dot]")).join(str(r.randrange(1, 256)) for _ in range(4))

    def other() -> str:
        return r.choice((
            lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{num(4)} {num(4)} {num(4)}",
            lambda: f"{r.randint(1, 9)}.{num(2)}.{num(3)}.{num(4)}", lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{num(5)}-{num(9)}", lambda: num(10), lambda: num(13), lambda: num(7),
            lambda: f"{r.randint(1, 99)} {num(3)} {num(3)}", lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}/20{num(2)} {num(2)}",
            lambda: f"{num(3)} {num(4)} {num(5)}", lambda: f"{word()} at the {word()}.{word()}", lambda: f"1{num(3)}-1{num(3)}", lambda: f"{num(16)}", lambda: f"{word()} @ {word()} {word()}. {word()}",
            lambda: f"{word()} at {word()}.{r.choice(sorted(TLDS))}", lambda: f"{word()} at {word()}.{r.choice(sorted(TLDS))} at {word()}", lambda: " ".join(year() for _ in range(r.randint(2, 5))), no_card,
            lambda: f"{r.randint(1, 99)}" + "".join(f".{num(3)}" for _ in range(r.randint(2, 4))), lambda: f"{r.randint(1, 99)}.000.000 {r.choice(('', word() + ' '))}{r.randint(1, 99)}.000.000", lambda: f"{r.randint(1, 40)} {num(4)} {num(4)}",
            lambda: ":".join(f"{r.randrange(256):02X}" for _ in range(6)), lambda: f"{r.randint(1, 150)}:{r.randint(1, 150)}:{r.randint(1, 9)}", lambda: f"{r.randint(1, 31)}.{r.randint(10, 12)}.20{num(2)} {r.randint(10, 23)}.{num(2)}",
            lambda: f"{num(3)}-{num(3)}, {num(3)}-{num(3)}", lambda: f"{num(8)} {word()} {num(8)}", lambda: f"{num(4)}-{num(6)}-{num(4)}", lambda: f"{r.randint(1, 9)} {num(3)} 000 {word()} {year()}",
        ))()

    made = {"email": email, "ip": ip, "card": card, "phone": phone, "": other}
    out = []
    for _ in range(n):
        kind = r.choice(("email", "ip", "card", "phone", "", "", "", ""))
        value = made[kind]()
        cue = r.choice(CUES[kind] if kind else CUES["other"]) if r.random() < (0.6 if kind else 0.4) else word()
        text = " ".join([*(word() for _ in range(r.randint(0, 5))), cue + r.choice(("", ":")), value]) + r.choice((" ", ". ", ", ")) + " ".join(word() for _ in range(r.randint(0, 5)))
        out.append((text, [(kind, value)] if kind else []))
    return out


def _labelled(sentences: list[tuple[str, list[tuple[str, str]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, kinds = [], [], []
    for text, real in sentences:
        for kind, s, e in candidates(text):
            x.append(features(text, kind, s, e))
            y.append(any(kind == k and text[s:e].strip() == v.strip() for k, v in real))
            kinds.append(kind)
    return np.array(x), np.array(y), np.array(kinds)


def limit_of(p: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: float = 0.5) -> float:
    """The probability that parts taken from left candidates best: the middle of the gap at which the weighted F measure, precision counting more, is largest."""
    order = np.argsort(-p, kind="stable")
    q, hit, w = p[order], (y * weight)[order], weight[order]
    if not hit.any():
        return 1.1
    taken = np.cumsum(hit)
    f = (1 + beta**2) * taken / (beta**2 * hit.sum() + np.cumsum(w))
    f[:-1][q[:-1] == q[1:]] = -1  # equal probabilities are taken together
    k = int(np.argmax(f))
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0.0)) / 2)


def train(train_rows: int = 6000, seed: int = 5) -> tuple[Boosted, dict[str, float]]:
    """The trees, learnt from made sentences, and a threshold for each kind.

    Thresholds come from the hand-labelled sentences and from made ones of
    another seed, either half of the weight.
    """
    model = Boosted().fit(*_labelled(_sentences(train_rows, seed))[:2])
    made, hand = _labelled(_sentences(train_rows // 2, seed + 1)), _labelled(SENTENCES)
    limits = {}
    for kind in KINDS:
        own = [(model.predict(x[k == kind]), y[k == kind]) for x, y, k in (made, hand) if (k == kind).any()]
        weight = np.concatenate([np.full(len(p), 1 / len(p)) for p, _ in own])
        limits[kind] = limit_of(np.concatenate([p for p, _ in own]), np.concatenate([y for _, y in own]).astype(float), weight)
    return model, limits


@functools.lru_cache(1)
def _trained() -> tuple[Boosted, dict[str, float]]:
    return train()


def added_spans(text: str, base: dict[str, list[Span]], model: Boosted, limits: dict[str, float]) -> dict[str, list[Span]]:
    """The candidates that the model takes, best first, clear of each other and of all base spans."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    found = candidates(text)
    if found:
        p = model.predict(np.array([features(text, *c) for c in found]))
        # Sorted, disjoint spans, so that a look at the two neighbours decides.
        import bisect

        taken: list[Span] = []
        for s, e in sorted(x for v in base.values() for x in v):
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k][1], found[k][2])):
            kind, s, e = found[k]
            if p[k] < limits[kind]:
                continue
            at = bisect.bisect_left(taken, (s, e))
            if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                taken.insert(at, (s, e))
                out[kind].append((s, e))
    return out


def find(documents: DataFrame, model: tuple[Boosted, dict[str, float]] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each whole text, by kind, then start."""
    trees, limits = model or _trained()
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def run(batch):
            rows = []
            for text in C.texts(batch):
                base = base_spans(text)
                more = added_spans(text, base, trees, limits)
                rows.append([{"kind": k, "start": s, "end": e, "base": b} for k in KINDS for s, e, b in sorted([(*x, True) for x in base[k]] + [(*x, False) for x in more[k]])])
            return {"doc_id": C.column(batch, "doc_id"), "spans": rows}

        return run

    return C.map_batches(documents.select("doc_id", "text"), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", make)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans are merged."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find(C.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    more = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), more)


def brute_base(text: str) -> dict[str, list[Span]]:
    """The base spans by the contract's patterns as they stand; for tests on short texts."""
    whole = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(_digits(s)) <= 19 and luhn(_digits(s)), "phone": lambda s: 8 <= len(_digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if good[k](m[0])] for k, p in whole.items()}


def spans_sha256(spans: dict[str, list[Span]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]).encode()).hexdigest()
