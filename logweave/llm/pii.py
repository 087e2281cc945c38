"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and reports anchors: at-signs,
``://`` schemes, plus signs before a digit, dots before a digit, digits, and
identifier cues (``ssn``, ``iban``, ...).  From each anchor a small local parser
walks left and right, so a span's borders depend only on the text around its
anchor; Luhn, octet, IBAN and length rules then validate it.

Base kinds follow fixed patterns, leftmost and without overlap per kind:
``email``, ``ip``, ``card``, ``phone``.  The anchors also give ``login`` (user
information in a URL), ``iban`` (mod-97 valid) and ``ident`` (digits behind a
cue).  Kinds may overlap each other.

Defined cases: null or empty text has no span; a row with a null id stays a
row; repeated rows stay repeated; other input columns are ignored; an empty
table gives an empty table.  Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("login", "iban", "ident")
CUES = ("ssn", "social security", "passport", "tax id", "account no", "account number", "konto", "dni", "nir")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@:]+(?::[^\s/?#@]*)?@")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IDENT = re.compile(r"[\x20:#=.]{1,4}([0-9][0-9A-Z-]{4,18}[0-9A-Z])(?![A-Za-z0-9])")
_DIGIT = frozenset("0123456789")


@lru_cache(maxsize=1)
def _automaton():
    anchors = {"@": "at", "://": "scheme"}
    for d in "0123456789":
        anchors[d] = "digit"
        anchors["." + d] = "dot"
        anchors["+" + d] = "plus"
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            anchors[form] = "cue"
    anchors["IBAN"] = anchors["Iban"] = anchors["iban"] = "iban"
    a = ahocorasick.Automaton()
    for word, kind in anchors.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    code = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def _email(text, at, floor):
    """Span of the address around the at-sign, walking left no further than ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _addresses(text, chain):
    """Groups of four consecutive parts of a dotted digit chain."""
    parts, at = text[chain.start():chain.end()].split("."), chain.start()
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        size = sum(map(len, four)) + 3
        if all(map(_octet, four)):
            yield at, at + size
        at += size + 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)``, by kind in the order of ``KINDS``, then start."""
    if not text:
        return []
    found = {k: [] for k in KINDS}
    email_end = chain_end = run_end = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= run_end:
                if run := _DIGITS.match(text, at):
                    run_end = run.end()
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, run_end))
        elif kind == "dot":
            if at >= chain_end and at and text[at - 1] in _DIGIT:
                start = at
                while start > chain_end and text[start - 1] in _DIGIT:
                    start -= 1
                chain = _CHAIN.match(text, start)
                chain_end = chain.end()
                found["ip"].extend(_addresses(text, chain))
        elif kind == "plus":
            if m := _PHONE.match(text, at):
                if 9 <= sum(c in _DIGIT for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "at":
            if span := _email(text, at, email_end):
                email_end = span[1]
                found["email"].append(span)
        elif kind == "scheme":
            if m := _LOGIN.match(text, last + 1):
                found["login"].append((m.start(), m.end() - 1))
        elif kind == "iban":
            if (m := _IBAN.search(text, last + 1, last + 50)) and _iban_valid(m.group()):
                found["iban"].append(m.span())
        elif m := _IDENT.match(text, last + 1):
            if sum(c in _DIGIT for c in m.group(1)) >= 5:
                found["ident"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in dict.fromkeys(sorted(found[k]))]


def redact(text: str | None, spans) -> str | None:
    """``text`` with every span replaced by ``[KIND]``; overlapping spans merge."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{kind.upper()}]")
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def _spans_of(batches):
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], ["doc_id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)``, one row per input row."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_spans_of, f"doc_id {kind}, spans {_SPAN_SQL}")


def _redacted(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [redact(t, find(t)) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; all columns stay.

    ``n_chars``, if there, is counted anew.  Null texts stay null.
    """
    prepare(docs.sparkSession)
    out = docs.mapInArrow(_redacted, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as one string."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
