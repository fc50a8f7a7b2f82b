r"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, URL schemes, plus signs before a digit, digits, and words that announce an
identifier. From each anchor a deterministic local parser expands to both sides and validates the boundary:

* email: local part to the left of "@", at least two labels to the right
* ip: four dot-joined digit runs, each part at most 255
* card: digits with single spaces or hyphens between, 13 to 19 digits, Luhn
* phone: "+" and digits with separators, 9 to 15 digits
* url: scheme, host, and what follows up to white space or a quote, without closing punctuation
* account: the identifier behind a cue ("account", "iban", "token", ...), 6 characters or more with a digit; an IBAN must pass mod 97

Spans of a kind do not overlap; the leftmost comes first, and a failed candidate is not tried again in parts. Offsets are code points,
the end is exclusive.

Defined results
* Null text counts as empty: no spans. Repeated rows each give a row. Extra columns are ignored. An empty table gives no rows.
* Whole texts are read; work is linear in their length but for the white space and brackets behind a plus sign.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_row, prepare, ship, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "ssn", "passport", "token", "api_key", "apikey", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9\[][^\s\"'<>\\`{}|^]*")
_ACCOUNT = re.compile(r"[ \t]*(?:(?:no|number|id)\b\.?)?[ \t]*[:=#]?[ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors with the kind of parser they call."""
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    a.add_word("@", ("at", 1))
    for s in SCHEMES:
        for x in (s, s.upper(), s.capitalize()):
            a.add_word(x, ("scheme", len(x)))
    for c in CUES:
        for x in {c, c.upper(), c.capitalize()}:
            a.add_word(x, ("cue", len(x)))
    a.make_automaton()
    return a


def finder():
    """``find(text) -> {kind: [(start, end), ...]}`` in ascending order."""
    anchors = automaton()

    def find(text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        past = dict.fromkeys(KINDS, 0)
        for last, (kind, size) in anchors.iter(text):
            at = last + 1 - size
            if kind == "digit":
                if at >= past["card"]:
                    m = _CARD.match(text, at)
                    past["card"] = m.end() if m else at + 1
                    if m:
                        digits = re.sub("[ -]", "", m[0])
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
                if at >= past["ip"]:
                    m = _IP.match(text, at)
                    if m:
                        past["ip"] = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                            found["ip"].append(m.span())
                    else:  # no later start in this run of digits can do better
                        end = at + 1
                        while end < len(text) and "0" <= text[end] <= "9":
                            end += 1
                        past["ip"] = end
            elif kind == "at":
                start = at
                while start > past["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    found["email"].append((start, m.end()))
                    past["email"] = m.end()
                else:
                    past["email"] = max(past["email"], at)
            elif kind == "plus":
                if at >= past["phone"] and (m := _PHONE.match(text, at)):
                    past["phone"] = m.end()
                    if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif kind == "scheme":
                if at >= past["url"] and (m := _URL.match(text, last + 1)):
                    end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                    past["url"] = m.end()
                    if end > last + 1:
                        found["url"].append((at, end))
            elif at >= past["account"] and (at == 0 or not text[at - 1].isalnum()):
                m = _ACCOUNT.match(text, last + 1)
                if m and m.start(1) > last + 1:
                    past["account"] = m.end()
                    value = m[1]
                    if any("0" <= c <= "9" for c in value) and (text[at:last + 1].lower() != "iban" or _IBAN.match(value) and iban(value)):
                        found["account"].append(m.span(1))
        return found
    return find


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])


def _start():
    find = finder()

    def row(doc_id, text):
        found = find(text or "")
        joined = {k: [f"{k}:{a}:{b}" for a, b in found[k]] for k in KINDS}
        base = ",".join(x for k in BASE for x in joined[k])
        return (doc_id, *[len(found[k]) for k in BASE], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for k in KINDS for x in joined[k]))
    return row


ship(__name__)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every text."""
    return per_row(docs, ["doc_id", "text"], None, _SCHEMA, _ARROW, _start)


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return personal_data(table(spark, folder, "documents", "doc_id", "text"))
