"""Personal data by candidate gradient boosting (operator 8).

Base spans (email, ip, card, phone) come from linear scans with format checks
and always stay.  High-recall generators propose further, overlapping spans:
number runs and their pieces, spelt-out addresses, hex groups.  Boosted trees
score each proposal from its format (digits, separators, checksum, ...) and its
context (words before it); a threshold for each kind, calibrated on held-out
candidates to a given precision, selects what is redacted, best scores first,
never over a base span or another selected one.

The trees are fitted on the driver on a bounded sample: feature rows of
candidates of about ``sample_docs`` documents (chosen by hash of the id), at
most ``sample_rows`` of them, and ``made_rows`` made examples: accepted formats
rewritten the way people disguise them, and numbers that are no personal data.
A candidate of a document is a positive if a base rule accepts the span and a
negative only if a rule shows it to be something else (a failed checksum, a date,
the end of a sentence); what no rule decides has no label and is left out, so
personal data in the corpus never counts against itself.  Thresholds come from
labelled rows that ``select`` can meet, so not from base spans.  Scoring is row
by row in the tasks: no shuffle, memory bounded by a batch of texts.

Defined results: a null or empty text has no spans; documents are judged row by
row, whatever their ids; on an empty table only the made examples train the
trees; other columns pass through, those called like an output are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.boosting import BoostedTrees, precise_threshold
from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import query, read

SAMPLE_DOCS, SAMPLE_ROWS, MADE_ROWS = 2_000, 20_000, 4_000
PRECISION = 0.99
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("spelt_email", "ip6", "local_phone", "national_id", "account")
KINDS = BASE_KINDS + MORE_KINDS
# words that go before personal data of some kind, and before other numbers, in English, German, French and Spanish
HINTS = {
    "email": ("mail", "contact", "write to", "kontakt", "schreib", "contacto", "correo", "courriel", "escrib", "écri"),
    "ip": ("ip", "host", "address", "server", "adresse", "rechner", "serveur", "servidor", "dirección", "direccion"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "reach", "anruf", "handy", "rufnummer", "appel", "portable", "móvil", "movil", "llam"),
    "id": ("ssn", "social", "passport", "national", "id", "steuer", "ausweis", "versicherung", "numéro", "numero", "identi", "pass", "seguridad", "sécurité", "dni", "nif"),
    "account": ("iban", "account", "bank", "konto", "überweis", "compte", "virement", "cuenta", "banco", "transfer"),
    "other": ("version", "isbn", "order", "page", "article", "section", "price", "ref", "serial", "part", "year", "seite", "bestell", "preis", "commande", "prix",
              "pedido", "página", "precio", "artikel", "artículo", "jahr", "année", "año"),
}
NEIGHBOURS = 24  # classes of hashed words just before a candidate
# Characters of an account number (IBAN) by country, as registered.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
Span = tuple[str, int, int]

_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_run = re.compile(r"[(+]?[0-9](?:[ ().\-/]{0,2}[0-9])+")
_piece = re.compile(r"[^ ]+")
_at = re.compile(r" ?(?:\[at\]|\(at\)| at(?= ))", re.I | re.A)
_spelt_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
_spelt_domain = re.compile(r" {0,2}[A-Z0-9-]{1,64}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Z0-9-]{2,24}){1,4}", re.I | re.A)
_ip6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:|:(?=:))[0-9A-Fa-f:]{0,34}(?:[0-9A-Fa-f]|::)(?![0-9A-Za-z:])")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local_chars:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        else:
            done = max(done, at)  # nothing before this sign can belong to a later one
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind as listed, then start."""
    spans = list(_emails(text))
    spans += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(map(_octet, m.group().split(".")))]
    spans += [("card", m.start(), m.end()) for m in _card.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    spans += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return spans


def _number_kind(s: str) -> str:
    return "national_id" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) else "local_phone"


def _spelt(text: str) -> Iterator[Span]:
    """Spelt addresses around each mark for the at sign."""
    for m in _at.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _spelt_local:
            start -= 1
        if start < m.start() and (d := _spelt_domain.match(text, m.end())):
            yield "spelt_email", start, d.end()


def proposals(text: str) -> list[Span]:
    """Overlapping candidate spans of the further kinds."""
    found = []
    for m in _run.finditer(text):
        pieces = [(m.start() + p.start(), m.start() + p.end(), len(_digits(p.group()))) for p in _piece.finditer(m.group())]
        for i in range(len(pieces)):  # all ranges of pieces with 7 to 19 digits; each piece has one at least
            a, digits = pieces[i][0], 0
            for _, b, n in pieces[i:i + 19]:
                digits += n
                if digits > 19:
                    break
                if digits >= 7:
                    found.append((_number_kind(text[a:b]), a, b))
    if ":" in text:
        found += [("ip6", m.start(), m.end()) for m in _ip6.finditer(text) if m.group().count(":") > 2 or "::" in m.group()]
    found += [("account", m.start(), m.end()) for m in _iban.finditer(text)]
    return found + list(_spelt(text))


_more_before = re.compile(r"[0-9][ ().\-/]{1,2}\Z")
_more_after = re.compile(r"[ ().\-/]{1,2}[0-9]")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 40):start].lower(), text[end:end + 1]
    marks = [c for c in s if not c.isalnum()]
    groups = re.findall(r"[0-9]+", s)
    checked = _iban_ok(s) if kind == "account" else _ip6_ok(s) if kind == "ip6" else False
    near = _word_before(text, start)
    shape = re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{2,4}\)?[ /.-][0-9]{3,4}[ .-]?[0-9]{3,5}", s)
    return [float(x) for x in (
        KINDS.index(kind), len(s), len(digits), len(marks), len(set(marks)), len(set(digits)), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), luhn(digits) if digits else False,
        s[:1] == "+", s[:1] == "(", "/" in s, "." in s, "-" in s, " " in s, "(" in s, checked, shape is not None,
        all(len(g) < 4 and int(g) < 256 for g in groups) if groups else False,
        bool(re.search(r"\b(19|20)[0-9]{2}\b", s)), before[-1:].isalnum(), after.isalnum(),
        "[" in s, " at " in s.lower(), " dot " in s.lower(), ". " in s, s[-1:].isalpha(),
        _more_before.search(text, max(0, start - 4), start) is not None, _more_after.match(text, end) is not None, *(any(h in before for h in words) for words in HINTS.values()),
        *(near == k + 1 for k in range(NEIGHBOURS)))]


def _ip6_ok(s: str) -> bool:
    """Eight groups, or fewer with one run of zero groups left out."""
    try:
        return int(ipaddress.IPv6Address(s)) > 1
    except ValueError:
        return False


def _word_before(text: str, start: int) -> int:
    """Class of the word just before a candidate, 0 if there is none: context beyond the listed words."""
    m = _last_word.search(text, max(0, start - 40), start)
    return 1 + zlib.crc32(m.group(1).lower().encode()) % NEIGHBOURS if m else 0


_last_word = re.compile(r"([^\W\d_]+)[^\w\n]*\Z")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) == IBAN_LENGTHS.get(s[:2]) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ruled_out(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a rule shows the candidate to be something other than personal data."""
    s = text[start:end]
    if kind == "account":
        return not _iban_ok(s)
    if kind == "ip6":
        return not _ip6_ok(s)
    if kind == "spelt_email":  # a sentence ends inside, or no domain ends like this
        return re.search(r"\. [A-Z]", s) is not None or not re.split(r"[^A-Za-z0-9-]", s)[-1].isalpha()
    if kind == "local_phone":
        digits = _digits(s)
        isbn = len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(digits)) % 10 == 0
        return isbn or _date(s) or (len(digits) > 15 and not luhn(digits))  # too long for a phone, no card
    return False


_year_first = re.compile(r"(?:19|20)[0-9]{2}([./-])([0-9]{1,2})\1([0-9]{1,2})")
_year_last = re.compile(r"([0-9]{1,2})([./-])([0-9]{1,2})\2(?:19|20)[0-9]{2}")
_years = re.compile(r"(?:1[0-9]|20)[0-9]{2} ?[-/] ?(?:1[0-9]|20)[0-9]{2}")


def _date(s: str) -> bool:
    if m := _year_first.fullmatch(s):
        return 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31
    if m := _year_last.fullmatch(s):
        a, b = sorted((int(m[1]), int(m[3])))
        return 1 <= a <= 12 and b <= 31
    return _years.fullmatch(s) is not None


# sentences around a span, by family: the trees never see the second one
FAMILIES = (
    ("{w} {w} {h}: {x} {w} {w}.", "{w}, {h} {x}", "{h}={x}; {w} {w}", "{w} {w} ({h} {x}) {w}."),
    ("{w} {w} {w}. {h} - {x}, {w} {w} {w}", "{w}\n{h}\t{x}\n{w} {w}", "«{h}» {x}! {w}"),
)
COUNTRIES = (("DE", "FR", "GB", "NO", "AT", "PL", "IT", "BE", "CH", "SE", "PT", "FI", "GR"), ("ES", "NL", "LU", "DK", "IE", "CZ", "HU", "MT"))


def _account(r: random.Random, country: str) -> str:
    """An account number of the country's length with true check digits."""
    body = "".join(r.choice("0123456789") for _ in range(IBAN_LENGTHS[country] - 4))
    if r.random() < 0.3:
        body = "".join(r.choice("ABCDEFGHKLMNP") for _ in range(4)) + body[4:]
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    s = f"{country}{check:02d}{body}"
    return " ".join(s[k:k + 4] for k in range(0, len(s), 4)) if r.random() < 0.4 else s


def _address6(r: random.Random) -> str:
    groups = [f"{r.randrange(1 << 16):{r.choice(['x', '04x'])}}" for _ in range(8)]
    if r.random() < 0.5:
        return ":".join(groups)
    a = r.randint(0, 5)
    return ":".join(groups[:a]) + "::" + ":".join(groups[a + r.randint(2, 8 - a):])


def made_examples(n: int, seed: int = 8, family: int = 0) -> list[tuple[str, Span, int]]:
    """Texts with one span each: disguised personal data (1) and other numbers (0).

    Families differ in the sentences, in the countries of account numbers and in which half of
    the words before a span they use.
    """
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    hints = {k: words[family::2] for k, words in HINTS.items()}
    out = []
    for i in range(n):
        good = i % 2 == 0
        kind = MORE_KINDS[(i // 2) % len(MORE_KINDS)]
        hint, sure, left, right = "other", kind == "national_id", "", ""  # sure: only the words before tell
        if kind == "spelt_email":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" at ", ".")])
            sure = (at, dot) == (" at ", ".")
            end = r.choice(["com", "org", "net", "de", "fr", "es"])
            span = f"{word()}{at}{word()}{dot}{end}" if good or sure else f"{word()} at {word()}. {word()}"
            if r.random() < 0.2:
                span = span.upper()
            hint = "email"
        elif kind == "ip6":
            span = _address6(r) if good else r.choice([":".join(num(2) for _ in range(4)), ":".join(num(2) for _ in range(3)) + "::" + num(5)[:4] + ":0:0:0:0:0"])
            hint = "ip"
        elif kind == "local_phone":
            sep = r.choice(" .-")
            pairs = sep.join([f"0{r.randint(1, 9)}", *(num(2) for _ in range(4))])
            threes = " ".join(num(3) for _ in range(3))
            span = r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)}/{num(4)}{num(2)}", pairs, f"0{num(3)} {num(7)}"]) if good else r.choice(
                [num(r.randint(7, 19)), f"{num(2)}.{num(2)}.20{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(3)}",
                 f"{num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", threes])
            if not good and r.random() < 0.3:  # a part of a phone number
                whole = [f"0{r.randint(1, 9)}", *(num(2) for _ in range(4))]
                a, b = r.choice([(0, 4), (1, 5)])
                left, span, right = ("".join(f"{p} " for p in whole[:a]), " ".join(whole[a:b]), "".join(f" {p}" for p in whole[b:]))
            hint = "phone"
        elif kind == "national_id":
            span = f"{num(3)}-{num(2)}-{num(4)}"
            hint = "id"
        else:
            country = r.choice(COUNTRIES[family])
            span = _account(r, country)
            if not good:  # one digit off, another length, or no such country
                k = r.randrange(len(span) - 1, 3, -1)
                off = "".join(str((int(c) + 1) % 10) if j == k and c.isdigit() else c for j, c in enumerate(span))
                span = r.choice([off if off != span else span[:3] + str((int(span[3]) + 1) % 10) + span[4:], f"{r.choice('ABCDEFGH')}Q{num(18)}"])
            hint = "account"
        hinted = r.random() < (0.9 if good or left or right else 0.1) or (sure and good)
        lead = r.choice(hints[hint if hinted and (good or not sure) else "other"]) if hinted or not good else word()
        head, tail = r.choice(FAMILIES[family]).split("{x}")
        fill = lambda t: re.sub(r"\{w\}", lambda _: word(), t).replace("{h}", lead)
        head = fill(head) + left
        out.append((f"{head}{span}{right}{fill(tail)}", (kind, len(head), len(head) + len(span)), int(good)))
    return out


class Model:
    """Boosted trees and a score threshold for each further kind.

    Rows outside ``judged`` (all are in it by default) only train the trees.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION, judged: np.ndarray | None = None):
        held = np.arange(len(y)) % 3 == 0
        if judged is not None:
            held &= judged
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        score = self.trees.score(x[held])
        self.held_out = (score, y[held], x[held][:, 0])
        self.least = {k: precise_threshold(score[(m := x[held][:, 0] == KINDS.index(k))], y[held][m], precision) for k in MORE_KINDS}

    def select(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """For each text the further spans that the thresholds let pass."""
        found = [[p for p in proposals(t) if not any(a < p[2] and p[1] < b for _, a, b in spans)] if spans else proposals(t)
                 for t, spans in zip(texts, base)]
        rows = [(i, p) for i, f in enumerate(found) for p in f]
        out: list[list[Span]] = [[] for _ in texts]
        if not rows:
            return out
        score = self.trees.score(np.array([features(texts[i], *p) for i, p in rows]))
        taken: list[set[int]] = [set() for _ in texts]
        for k in sorted(range(len(rows)), key=lambda k: (-score[k], rows[k][1][1], -rows[k][1][2])):
            i, p = rows[k]
            if score[k] >= self.least[p[0]] and taken[i].isdisjoint(range(p[1], p[2])):
                taken[i].update(range(p[1], p[2]))
                out[i].append(p)
        return out


def _render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()),
                      T.StructField("spans", T.StringType())])


def _finder(model: Model):
    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [t or "" for t in series]
            base = [base_spans(t) for t in texts]
            rows = []
            for spans, more in zip(base, model.select(texts, base)):
                rows.append((*(sum(s[0] == k for s in spans) for k in BASE_KINDS), hashlib.sha256(_render(spans).encode()).hexdigest(), _render(spans + more)))
            yield pd.DataFrame(rows, columns=FOUND.names)
    return find


def _clear_of(spans: set[tuple[int, int]]):
    """A test of whether a range overlaps none of the spans, in the logarithm of their number."""
    ends, starts = [], []
    for a, b in sorted(spans):  # joined to disjoint ranges
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def clear(a: int, b: int) -> bool:
        i = bisect.bisect_right(ends, a)
        return i == len(starts) or starts[i] >= b
    return clear


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS,
        sample_rows: int = SAMPLE_ROWS, made_rows: int = MADE_ROWS) -> Model:
    def rows(batches):
        for b in batches:
            out = []
            for key, t in zip(b["key"], b["text"]):
                plain = {s[1:] for s in base_spans(t)}
                clear = _clear_of(plain)
                for k, a, e in proposals(t):
                    if (a, e) in plain:
                        out.append((key, a, e, features(t, k, a, e), 1, False))
                    elif clear(a, e) and ruled_out(t, k, a, e):
                        out.append((key, a, e, features(t, k, a, e), 0, True))
            yield pd.DataFrame(out, columns=["key", "a", "e", "x", "y", "judged"])

    share = max(1, docs.count() // sample_docs)
    picked = docs.select(F.xxhash64(doc_id).alias("key"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull() & (F.pmod("key", F.lit(share)) == 0))
    got = picked.mapInPandas(rows, "key long, a int, e int, x array<double>, y int, judged boolean").orderBy("key", "a", "e").limit(sample_rows).collect()
    made = [(features(t, *s), y) for t, s, y in made_examples(made_rows)]
    x = np.array([r.x for r in got] + [m[0] for m in made])
    y = np.array([r.y for r in got] + [m[1] for m in made])
    judged = np.array([r.judged for r in got] + [True] * len(made))
    mixed = np.random.default_rng(8).permutation(len(y))
    return Model(x[mixed], y[mixed], judged=judged[mixed])


def with_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_sha256`` and ``spans`` (``kind:start:end`` by kind, then start)."""
    found: Column = _finder(model or fit(docs, text, doc_id))(F.col("text"))
    rows = packed(docs, text=F.col(text)).select("row", found.alias("f")).select("row", *(F.col(f"f.{c}").alias(c) for c in FOUND.names))
    return unpacked(rows, docs.columns, FOUND.names)


@query("op8_personal_data")
def op8_personal_data(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_personal_data(docs).drop("text")
