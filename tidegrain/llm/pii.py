"""Personal data: patterns propose spans, checksums confirm, context scores.

Kinds are email, ip, card (Luhn) and phone, as the base rules define them, and
iban (mod-97), which the method adds.  Words near a span raise or lower its
score; a span of the method must reach METHOD_SCORE, so a counter word without
a context word drops it.  The score never removes a base span.  All scans are
linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import need, small_batches

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_ANY_DIGIT = re.compile("[0-9]").search

# Characters of an IBAN by country, from the registry of ISO 13616.
IBAN_SIZES = {
    code: size
    for size, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

#: Score of a confirmed span, and what a context word adds to it or a counter word takes.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
CONTEXT_GAIN = 0.2
#: Score that spans of kinds beyond the base ones must reach.
METHOD_SCORE = 0.7
CONTEXT_CHARS = 40
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|visa|master|karte|tarjeta|carte|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|llame|appelez)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
}
COUNTER = re.compile(r"(?i)\b(?:version|isbn|serial|build|release|example|order)\b")


def luhn(digits: str) -> bool:
    """Luhn's checksum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod-97 of an IBAN without spaces: 15 to 34 characters, remainder 1."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        groups = [(g.start(), g.end(), g[0]) for g in _DIGITS.finditer(text, m.start(), m.end())]
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            if all(len(v := g[2].lstrip("0")) <= 3 and int(v or 0) <= 255 for g in four):
                out.append((four[0][0], four[3][1]))
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans from a country code to the end of a word that pass mod-97.

    Countries of the registry have one length each; for others every end is
    tried, longest first.  What follows an IBAN may itself look like a part of it.
    """
    out, last = [], 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.match(text, m.end()) if m.start() >= last else None
        if not rest:
            continue
        ends = [(e.end(), text[m.start() : e.end()].replace(" ", "")) for e in _IBAN_END.finditer(text, m.end(), rest.end() + 1) if e.end() <= rest.end()]
        usual = IBAN_SIZES.get(m[0][:2])
        ends.sort(key=lambda x: -len(x[1]))
        end = next((e for e, iban in ends if len(iban) == (usual or len(iban)) and mod97(iban)), None)
        if end:
            out.append((m.start(), end))
            last = end
    return out


def find(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end (exclusive, code points) and score of every span, by kind and then start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if _ANY_DIGIT(text):
        for kind, scan in (("ip", ips), ("card", cards), ("phone", phones), ("iban", ibans)):
            found += [(kind, *x) for x in scan(text)]
    scored = [(k, a, b, _score(text, k, a, b)) for k, a, b in found]
    return [x for x in scored if x[0] in BASE or x[3] >= METHOD_SCORE]


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    score = BASE_SCORE[kind] + CONTEXT_GAIN * (CONTEXT[kind].search(near) is not None) - CONTEXT_GAIN * (COUNTER.search(near) is not None)
    return round(min(1.0, max(0.0, score)), 2)


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
DIGESTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def _rows(docs: DataFrame) -> DataFrame:
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every whole text, one row for each input row.

    Null and empty texts have no spans; repeated rows each get a row; an
    empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": spans})

    return _rows(docs).mapInPandas(run, SPANS)


def digests(docs: DataFrame) -> DataFrame:
    """detect()'s spans as counts, a digest of the base spans and text lists.

    spans has kind:start:end of all spans, scores their scores in that order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                found = find(text)
                written = [f"{k}:{s}:{e}" for k, s, e, _ in found]
                base = ",".join(w for w, f in zip(written, found, strict=True) if f[0] in BASE)
                counts = [sum(f[0] == k for f in found) for k in BASE]
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(written), ",".join(str(f[3]) for f in found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return _rows(docs).mapInPandas(run, DIGESTS)


def redact_text(text: str | None, at_least: float = 0.0) -> str | None:
    """The text with each span replaced by its kind in brackets; where spans overlap, one placeholder names the first."""
    if not text:
        return text
    out, last = [], 0
    for k, s, e, score in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if score < at_least:
            continue
        if s >= last:
            out += [text[last:s], f"[{k.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, at_least: float = 0.0) -> DataFrame:
    """The same rows and columns with personal data in text replaced; null stays null."""
    need(docs, "text")
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, at_least))

    return docs.withColumn("text", mask("text"))
