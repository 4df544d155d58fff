"""Personal data and secrets: patterns propose spans, checksums confirm them, context words move the score.

Spans that follow from a base pattern and its checksum always stay.  All others must reach a score of
LEAST, which depends on the checksum or randomness of the span and on the words around it: an account
number with a wrong checksum goes, and so does a long hexadecimal word that stands beside "commit".

Defined results: a null text counts as empty and has no span; repeated rows each get their spans;
columns named like an added one are replaced; all other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "id", "secret")
#: Spans added to the base ones have at least this score.
LEAST = 0.5

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("base", T.BooleanType()),
    ]
)
ADDED = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])

_AT = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is never entered in its middle, so these take linear time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Identity numbers as some countries write them; those with a check letter start higher.
_ID = re.compile(r"(?<![\w-])(?:([0-9]{8}[A-Z])|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,8}|[0-9]{9})(?![\w-])")
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed values: the letter for each remainder by 23
# Random words, values given to a name that speaks of a secret, and key blocks.
_RANDOM = re.compile(r"(?<![\w+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![\w+/=-])")
_GIVEN = re.compile(r"""(?i)(?<![a-z])(?:password|passwd|pwd|passwort|secret|token|api[_ -]?key)["']?[ \t]*[:=][ \t]*["']?([^\s"',;]{6,})""")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)", re.S)
# How keys of well-known services begin.
_ISSUED = ("AKIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "eyJ")

#: Words near a span that make its kind likelier, and words that make it less likely.
FOR = {
    "email": ("mail", "contact", "contacto", "kontakt", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "id": ("ssn", "social", "security", "passport", "passeport", "pasaporte", "reisepass", "dni", "nif", "identity", "identidad", "personalausweis", "ausweis", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "passwort", "key", "apikey", "bearer", "authorization", "credential", "credentials"),
}
AGAINST = ("version", "release", "build", "section", "chapter", "isbn", "issn", "doi", "example", "commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "revision", "serial", "tracking")
#: Scores without context; that of added cards, identity numbers and secrets depends on the span as well.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.75}
ADDED_CARD, CHECKED_ID, PLAIN_ID, ISSUED, RANDOM, GIVEN = 0.6, 0.4, 0.25, 0.9, 0.35, 0.25
CONTEXT = 0.3
WINDOW = 40
# Words; parts of addresses and paths are none.
_WORD = re.compile(r"(?<![^\W_])(?<![.@/-])[^\W_]+(?![^\W_]|[@/]|\.[^\W_])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ in turn takes the whole run of name characters before it: what leftmost matching gives, in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        nxt = at + 1
        if at > free and text[at - 1] in _LOCAL and (m := _AT.match(text, at)):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            found.append((start, m.end()))
            free = nxt = m.end()
        at = text.find("@", nxt)
    return found


def _digits(text: str) -> str:
    return text.translate(_DROP)


_DROP = {ord(c): None for c in " -().+"}


def _cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Base spans, and cards found as neighbouring groups inside longer runs that fail as a whole: each valid
    range of groups that lies in no other, so that a chance hit hides no card (ranges may overlap)."""
    base, more = [], []
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            base.append(m.span())
        elif len(digits) > 16:
            groups = [g.span() for g in re.finditer("[0-9]+", m[0])]
            last = 0
            for i, (start, _) in enumerate(groups):
                size, hit = 0, 0
                for a, b in groups[i : i + 19]:  # a group has a digit at least
                    size += b - a
                    if size > 19:
                        break
                    if size >= 16 and luhn(_digits(m[0][start:b])):
                        hit = b
                if hit > last:
                    more.append((m.start() + start, m.start() + hit))
                    last = hit
    return base, more


def _entropy(word: str) -> float:
    """Bits a character."""
    n = len(word)
    return -sum(c / n * log2(c / n) for c in Counter(word).values())


def _secrets(text: str) -> list[tuple[int, int, float]]:
    """start, end and score without context, of spans that do not overlap."""
    some = [(*m.span(), ISSUED) for m in _KEY_BLOCK.finditer(text)]
    for m in _RANDOM.finditer(text):
        word = m[0]
        if word.startswith(_ISSUED):
            some.append((*m.span(), ISSUED))
        elif re.search("[0-9]", word) and re.search("[A-Za-z]", word) and _entropy(word) >= 3.0:
            some.append((*m.span(), RANDOM))
    for m in _GIVEN.finditer(text):
        if re.search(r"[^a-zà-ÿ]", m[1]):  # not a plain word
            some.append((*m.span(1), GIVEN))
    found, free = [], 0
    for a, b, score in sorted(some, key=lambda s: (s[0], -s[1], -s[2])):
        if a >= free:
            found.append((a, b, score))
            free = b
    return found


def _ids(text: str) -> list[tuple[int, int, float]]:
    checked = lambda m: m[1] and _CHECK_LETTERS[int(m[1][:8]) % 23] == m[1][8]
    return [(*m.span(), CHECKED_ID if checked(m) else PLAIN_ID) for m in _ID.finditer(text)]


def _words(text: str, start: int, end: int) -> set[str]:
    """The words wholly within WINDOW characters before a span and half as many behind it: what the window cuts is no word."""
    before = {m[0].lower() for m in _WORD.finditer(text, max(0, start - WINDOW), start)}  # looks at what stands before the window
    behind = _WORD.finditer(text[end : end + WINDOW])
    return before | {m[0].lower() for m in behind if m.end() <= WINDOW // 2}


def _score(text: str, kind: str, start: int, end: int, score: float) -> float:
    near = _words(text, start, end)
    score += CONTEXT * (not near.isdisjoint(FOR[kind])) - CONTEXT * (not near.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str, least: float = LEAST) -> list[dict]:
    """The spans of one text in listed order, base ones and those with a score of `least`; offsets are code
    points, ends exclusive."""
    found: dict[str, list[tuple[int, int, float, bool]]] = {}
    base = lambda kind, spans: [(a, b, START[kind], True) for a, b in spans]
    if "@" in text:
        found["email"] = base("email", _emails(text))
    if re.search("[0-9]", text):
        found["ip"] = base("ip", (m.span() for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) < 4 and int(p or "0") <= 255 for q in m[0].split("."))))
        cards, more = _cards(text)
        found["card"] = sorted(base("card", cards) + [(a, b, ADDED_CARD, False) for a, b in more])
        if "+" in text:
            found["phone"] = base("phone", (m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15))
        ibans = []
        for m in _IBAN.finditer(text):
            # the run may swallow upper-case words behind the account: the longest valid cut at a separator counts
            ends = [m.end() - m.start(), *(g.start() for g in reversed([*re.finditer("[ -]", m[0])]))]
            end = next((e for e in ends if 15 <= len(a := re.sub("[ -]", "", m[0][:e])) <= 34 and mod97(a)), None)
            if end:
                ibans.append((m.start(), m.start() + end, START["iban"], False))
        found["iban"] = ibans
        found["id"] = [(*s, False) for s in _ids(text)]
    found["secret"] = [(*s, False) for s in _secrets(text)]
    spans = [{"kind": k, "start": a, "end": b, "score": _score(text, k, a, b, score), "base": own} for k in KINDS for a, b, score, own in found.get(k, ())]
    return [s for s in spans if s["base"] or s["score"] >= least]


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `spans`: array of (kind, start, end, score, base) for the whole text of each row.

    base: the span follows from the pattern and checksum alone.  The others are added by the method if their
    score is LEAST or more: accounts by mod-97, cards inside longer runs of digits, identity numbers by check
    letter and context, secrets by randomness and context.
    """
    return map_texts(docs, text, ADDED, lambda: lambda texts: {"spans": [find(t) for t in texts]}, keep)


def mask(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """Replace each base span and each other span with a score of `least` or more by <KIND>; rows all stay."""

    def cut(t: str) -> str:
        spans = sorted((s["start"], s["end"], s["kind"]) for s in find(t, least))
        out, free = [], 0
        for a, b, kind in spans:
            if b <= free:
                continue
            out += [t[free : max(a, free)], f"<{kind.upper()}>"]
            free = b
        return "".join([*out, t[free:]]) if spans else t

    # a null text stays null
    name = f"__{text}__"
    added = T.StructType([T.StructField(name, T.StringType())])
    masked = map_texts(docs, text, added, lambda: lambda texts: {name: [cut(t) for t in texts]})
    return masked.select(*[F.when(F.col(f"`{n}`").isNotNull(), F.col(name)).alias(n) if n == text else F.col(f"`{n}`") for n in docs.columns])


def listing(spans: F.Column) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in their order), n_added."""
    found = detect(docs.select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 3)), ",").alias("scores"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
