"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and cue words before
identifiers. A small deterministic parser per kind then expands from the anchor to the boundaries and validates.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import keyed_text, pieces, rows

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order of reports; the last two are what the anchors add to the base patterns.
KINDS = (*BASE, "account", "profile")
#: Words before an account number, credential or other identifier.
CUES = ("account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "token", "api_key", "apikey", "passport", "ssn")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"(?:[\x20\t]?(?:no\.?|number|nr\.?|id))?[\x20\t]*[:=#]?[\x20\t]*[\"']?([A-Za-z0-9][A-Za-z0-9_-]{7,63})(?![A-Za-z0-9_-])")
_PROFILE = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:/(?:users?|profiles?|u|people|author)/|/[~@])[A-Za-z0-9._-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for d in "0123456789":
        machine.add_word(d, "digit")
    machine.add_word("@", "at")
    machine.add_word("+", "plus")
    machine.add_word("://", "scheme")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            machine.add_word(form, len(form))
    machine.make_automaton()
    return machine


def find_spans(text: str, machine) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each kind leftmost first and without overlaps within the kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = account = profile = 0  # where each kind's next match may start
    for last, tag in machine.iter(text):
        if tag == "digit":
            if last >= ip:
                if m := _IP.match(text, last):
                    ip = m.end()
                    if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
                        found["ip"].append(m.span())
                else:
                    ip = _DIGITS.match(text, last).end()
            if last >= card:
                if m := _CARD.match(text, last):
                    card = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                else:
                    card = last + 1
        elif tag == "at":
            start = last
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email = m.end()
                found["email"].append((start, m.end()))
        elif tag == "plus":
            if last >= phone and (m := _PHONE.match(text, last)):
                phone = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif tag == "scheme":
            if last >= profile and (m := _PROFILE.match(text, last + 1)):
                profile = m.end()
                found["profile"].append(m.span())
        else:  # a cue word: its length
            first = last - tag + 1
            if first >= account and not (first and text[first - 1].isalnum()):
                m = _VALUE.match(text, last + 1)
                if m and sum(c.isdigit() for c in m[1]) >= 4:
                    account = m.end(1)
                    found["account"].append(m.span(1))
    return found


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then longest, names it."""
    spans = sorted(((s, -e, k) for k in KINDS for s, e in found[k]))
    out, at = [], 0
    for start, neg_end, kind in spans:
        end = -neg_end
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(found, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all kinds) and,
    on request, ``redacted`` (the text with the spans replaced; null stays null).

    Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows are judged each for
    itself. Work is per row: no shuffle, memory bounded by the longest text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = "" if not redacted else ", redacted string"
    schema = (f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" + kept)

    def run(batches):
        machine = anchors()
        for batch in batches:
            out = pa.schema([batch.schema.field("doc_id"), *[pa.field(f"n_{k}", pa.int64()) for k in BASE],
                             pa.field("base_sha256", pa.string()), pa.field("spans", pa.string()),
                             *([pa.field("redacted", pa.string())] if redacted else [])])
            for part in pieces(batch):
                texts = [t.decode() if t is not None else None for t in part["text"]]
                found = [find_spans(t or "", machine) for t in texts]
                extra = {"redacted": [t if t is None else redact(t, f) for t, f in zip(texts, found)]} if redacted else {}
                yield rows(out, doc_id=part["doc_id"], **{f"n_{k}": [len(f[k]) for f in found] for k in BASE},
                           base_sha256=[hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found],
                           spans=[_joined(f, KINDS) for f in found], **extra)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema)


def without_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text redacted in place (n_chars, where there is one, follows the text)."""
    schema = docs.schema
    position = docs.columns.index(text_col)

    def run(batches):
        machine = anchors()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(position).to_pylist()
                new = [t if t is None else redact(t, find_spans(t, machine)) for t in texts]
                yield part.set_column(position, part.schema.field(position), pa.array(new, type=part.schema.field(position).type))

    clean = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType))
    return clean
