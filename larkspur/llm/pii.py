"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and reports its anchors: at signs, plus signs, digits,
schemes and identifier cues. Small deterministic parsers then expand each anchor to the left and right
and validate what they find: email, network address, card and phone (the base kinds), and, as spans that
the method adds, web addresses with a scheme, phone numbers after tel:, bank account numbers and identifiers
after a cue.

Base kinds are leftmost and do not overlap within a kind; a match that fails its validation is dropped
and the search goes on behind it. Kinds may overlap each other. Offsets are code points, end exclusive.

Results for odd rows: null text counts as empty and has no span; repeated rows give repeated results;
texts are scanned whole, in time linear in their length; a part of an address may have any number of digits
(leading zeros don't count, more than three others fail it); empty tables give empty results.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.common import in_parts, slim

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "tel", "iban", "id")
KINDS = BASE + ADDED
#: What is personal wherever it stands.
PERSONAL = tuple(k for k in KINDS if k != "url")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Anchors besides at sign, plus sign and digits; cues are matched in small, title and capital letters.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "tel:")
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "tax id", "driver license", "licence no")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What follows tel: (a plus sign is an anchor of its own).
DIALLED = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
#: What follows a scheme, up to white space, quotes or brackets.
WEB = re.compile(r"(?:[^\s/@\"'<>]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>()\[\]{}]*)?")
#: Between a cue and its number: a few filler words and marks.
FILLER = re.compile(r"(?:\s*(?:number|no|nr|id|code|is)\b\.?)?\s*[:#=]?\s*", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IDENTIFIER = re.compile(r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{0,3}[0-9]{6,17})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def in_byte(part: str) -> bool:
    """Whether digits stand for at most 255, however many there are."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def iban_holds(text: str) -> bool:
    """The check digits of a bank account number."""
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (1, c))
    for s in SCHEMES:
        for v in {s, s.upper(), s.capitalize()}:
            a.add_word(v, (len(s), s))
    for cue in CUES:
        for v in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(v, (len(cue), "cue"))
    a.make_automaton()
    return a


class Finder:
    """Finds the spans of a text. Keeps, per base kind, the end of the last match (dropped ones included)."""

    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end), by start, then kind as listed."""
        out: list[tuple[int, str, int]] = []
        email_end = ip_end = card_end = phone_end = url_end = tel_end = id_end = 0
        before = -2  # the last digit's place
        for end, (size, what) in self.anchors.iter(text):
            at = end - size + 1
            if what == "@":
                start = at
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    out.append((start, "email", email_end := m.end()))
            elif what == "+":
                if at >= phone_end and (m := PHONE.match(text, at)):
                    phone_end = m.end()
                    if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        out.append((at, "phone", phone_end))
            elif what == "cue":
                after = FILLER.match(text, end + 1).end()
                if after >= id_end and (at == 0 or not text[at - 1].isalnum()) and (after > end + 1):
                    if (m := IBAN.match(text, after)) and (found := self.account(m[0])):
                        out.append((after, "iban", id_end := after + found))
                    elif m := IDENTIFIER.match(text, after):
                        out.append((after, "id", id_end := m.end()))
            elif len(what) > 1:
                if what == "tel:":
                    if at >= tel_end and (at == 0 or not text[at - 1].isalnum()) and (m := DIALLED.match(text, end + 1)):
                        tel_end = m.end()
                        if 7 <= sum(c in "0123456789" for c in m[0]) <= 15:
                            out.append((end + 1, "tel", tel_end))
                elif at >= url_end and (m := WEB.match(text, end + 1)):
                    url_end = end + 1 + len(m[0].rstrip(".,;:!?"))
                    out.append((at, "url", url_end))
            else:
                first, before = before != at - 1, at
                if first and at >= ip_end and (m := ADDRESS.match(text, at)):
                    ip_end = m.end()
                    if all(map(in_byte, m[0].split("."))):
                        out.append((at, "ip", ip_end))
                if at >= card_end and (m := DIGITS.match(text, at)):
                    card_end = m.end()
                    if 12 <= len(m[0]) and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                        out.append((at, "card", card_end))
        return sorted(out, key=lambda x: (x[0], ORDER[x[1]], x[2]))

    @staticmethod
    def account(text: str) -> int:
        """The length of the longest part from the start, cut at a space or whole, that has valid check digits; 0 if none."""
        for n in (len(text), *(m.start() for m in reversed(list(re.finditer(" ", text))))):
            if iban_holds(text[:n]):
                return n
        return 0


#: One finder stays in a worker.
_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def shown(spans: list[tuple[int, str, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, k, e in spans])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as text) and spans (all)."""
    import pyarrow as pa

    slimmed = slim(docs, "doc_id", "text")
    schema = T.StructType([slimmed.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        look = finder()
        for batch in in_parts(batches):
            found = [look.spans(x or "") for x in batch.column(1).to_pylist()]
            base = [[x for x in f if x[1] in BASE] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in BASE]
            digests = pa.array([sha256(shown(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([shown(f) for f in found], pa.string())], names=schema.names)

    return slimmed.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans go as one, under the first one's kind."""
    out, done = [], 0
    open_at = None
    for s, k, e in spans:
        if open_at is not None and s < open_at[2]:
            open_at = (open_at[0], open_at[1], max(open_at[2], e))
            continue
        if open_at is not None:
            out += [text[done : open_at[0]], f"<{open_at[1].upper()}>"]
            done = open_at[2]
        open_at = (s, k, e)
    if open_at is not None:
        out += [text[done : open_at[0]], f"<{open_at[1].upper()}>"]
        done = open_at[2]
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, kinds: tuple[str, ...] = PERSONAL) -> DataFrame:
    """docs with personal data in text replaced by its kind, and n_chars (if there is one) counted again; null texts stay null.

    kinds: what is replaced. Web addresses are not personal as such and stay, unless "url" is named; mail and network
    addresses inside them go like any other.
    """
    import pyarrow as pa

    schema, names = docs.schema, docs.columns
    text_at = names.index("text")
    count_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        look = finder()
        for batch in in_parts(batches):
            texts = [x if x is None else masked(x, [y for y in look.spans(x) if y[1] in kinds]) for x in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if count_at is not None:
                columns[count_at] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
