"""Personal data: Aho-Corasick finds anchors, local parsers expand them.

One automaton finds at-signs, scheme marks, plus signs before digits, dots before digits, pairs of neighbouring
digits, countries of IBANs before digits and identifier cues in all texts of a batch. From each anchor a deterministic parser walks to the
boundaries of the address or number and checks it. All characters concerned are ASCII, so the scan
works on UTF-8 bytes and only the spans found are turned into code points.

Kinds: email, ip, card and phone are the base. account: an IBAN of its country's length with valid check digits
(behind an account cue, of any other country too), or a number of 6 to 17 digits behind an account cue. secret: a quoted or bare value of 16 or more characters with a digit behind a secret
cue and `=` or `:`. login: name and password inside a URL.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import as_bytes, map_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "login")

# Cues, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key")
#: Length of a country's IBANs.
IBAN_LENGTHS = {
    c: n
    for n, names in {
        15: "no", 16: "be", 18: "dk fi fk fo gl nl sd", 19: "mk si", 20: "at ba ee kz lt lu mn xk", 21: "ch hr li lv", 22: "bg bh cr de gb ge ie me rs va",
        23: "ae gi il iq om so tl", 24: "ad cz es md pk ro sa se sk tn vg", 25: "ly pt st", 26: "is tr", 27: "bi dj fr gr it mc mr sm", 28: "al az by cy do gt hu lb ni pl sv",
        29: "br eg ps qa ua", 30: "jo kw mu ye", 31: "mt sc", 32: "lc", 33: "ru",
    }.items()
    for c in names.split()
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?: (?:number|no\.?|nr\.?|num))?[ \t]*[:=#]?[ \t]*(?:([0-9](?:[ -]?[0-9]){5,16})(?![a-z0-9])|(?=[a-z]{2}[0-9]{2}))")
_IBANS = {n: re.compile(rf"[a-z]{{2}}[0-9]{{2}}(?: ?[a-z0-9]){{{n - 4}}}(?![a-z0-9])") for n in range(15, 35)}
_ASSIGN = re.compile(r"[ \t]*[:=][ \t]*[\"']?")
_SECRET = re.compile(r"[a-z0-9+/_=-]{16,}")
_LOGIN = re.compile(r"([^\x00-\x20\x7f/@:]+:[^\x00-\x20\x7f/@]+)@[a-z0-9]")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", ("email", 1))
    out.add_word("://", ("login", 3))
    for d in _DIGITS:
        out.add_word(f"+{d}", ("phone", 2))
        out.add_word(f".{d}", ("ip", 2))
        for e in _DIGITS:
            for mid in ("", " ", "-"):
                out.add_word(f"{d}{mid}{e}", ("card", 2 + len(mid)))
        for c in IBAN_LENGTHS:
            out.add_word(f"{c}{d}", ("iban", 3))
    for c in ACCOUNT_CUES:
        out.add_word(c, ("account", len(c)))
    for c in SECRET_CUES:
        out.add_word(c, ("secret", len(c)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an IBAN (lower case, without blanks) are right."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """End of the IBAN that starts here, 0 for none: at its country's length, or for other countries at the greatest length with right check digits."""
    size = IBAN_LENGTHS.get(text[at : at + 2])
    for n in [size] if size else range(34, 14, -1):
        m = _IBANS[n].match(text, at)
        if m and iban(m[0].replace(" ", "")):
            return m.end()
    return 0


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in a text whose letters A-Z are in lower case."""
    found = []
    email_end = chain_end = run_end = account_end = value_end = 0
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "card":
            if at < run_end:
                continue
            m = _RUN.match(text, at)
            run_end = m.end()
            if run_end - at >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, run_end))
        elif kind == "ip":
            if at < chain_end or not at or text[at - 1] not in _DIGITS:
                continue
            start = at
            while start > chain_end and text[start - 1] in _DIGITS:
                start -= 1
            m = _CHAIN.match(text, start)
            chain_end = m.end()
            parts = m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                    found.append(("ip", start, end))
                start = end + 1
        elif kind == "email":
            m = _DOMAIN.match(text, last + 1)
            if not m:
                continue
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                email_end = m.end()
                found.append(("email", start, email_end))
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m and 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                found.append(("phone", at, m.end()))
        elif at and text[at - 1] in _ALNUM and kind != "login":
            continue
        elif kind == "account":
            m = _ACCOUNT.match(text, last + 1)
            if m:
                start, end = m.span(1) if m[1] else (m.end(), iban_end(text, m.end()))
                if start >= account_end and end:
                    account_end = end
                    found.append(("account", start, end))
        elif kind == "iban":
            if at >= account_end and (end := iban_end(text, at)):
                account_end = end
                found.append(("account", at, end))
        elif kind == "secret":
            m = _ASSIGN.match(text, last + 1)
            # A cue inside a value that was looked at has nothing to add.
            if m and m.end() >= value_end and (m := _SECRET.match(text, m.end())):
                value_end = m.end()
                if any(c in _DIGITS for c in m[0]):
                    found.append(("secret", m.start(), value_end))
        else:
            m = _LOGIN.match(text, last + 1)
            if m and at and text[at - 1] in _SCHEME:
                found.append(("login", m.start(1), m.end(1)))
    return found


def spans_of(texts: list[bytes], automaton: ahocorasick.Automaton) -> list[list[tuple[int, int, int]]]:
    """Per text its spans as (number of the kind, start, end), in code points, by kind and start."""
    joined = b"\n".join(texts).lower()
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = scan(joined.decode("latin-1"), automaton)
    rows = np.searchsorted(first, [s for _, s, _ in found], side="right") - 1
    for (kind, start, end), r in zip(found, rows.tolist(), strict=True):
        out[r].append((KINDS.index(kind), start - int(first[r]), end - int(first[r])))
    for r in {*rows.tolist()}:
        raw = texts[r]
        if not raw.isascii():
            lead = np.cumsum(np.concatenate([[0], (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80]))
            out[r] = [(k, int(lead[s]), int(lead[e])) for k, s, e in out[r]]
        out[r].sort()
    return out


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and spans, an array of (kind, start, end) by kind as listed in KINDS, then start; code points, end exclusive.

    Spans of one kind don't overlap; those of different kinds may. Null and empty texts have none. Repeated rows each get a row. Only the columns named are read.
    """
    own = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work():
        automaton = _automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in spans_of(as_bytes(batch.column(1)), automaton)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["i", "spans"])

        return each

    kind = own.schema["i"].dataType.simpleString()
    return map_slices(own, "t", f"i {kind}, spans array<struct<kind:string,start:int,end:int>>", work).withColumnRenamed("i", id)


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in capitals between angle brackets; overlapping spans are replaced together, by the first kind's name."""
    out, at = [], 0
    merged: list[list[int]] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents with their personal data masked; all other columns and all rows stay. n_chars: a column to hold the new text's length.

    Null and empty texts, and those without personal data, stay as they are, and so does their n_chars. Repeated rows and rows with null or equal ids are
    masked alike. Texts of any length are read whole. An empty table gives an empty result.
    """
    where = docs.columns.index(text)
    sized = docs.columns.index(n_chars) if n_chars else -1

    def work():
        automaton = _automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = as_bytes(batch.column(where))
            found = spans_of(raw, automaton)
            at = [i for i, x in enumerate(found) if x]
            if not at:
                return batch
            new = {i: masked(raw[i].decode("utf-8", "replace"), found[i]) for i in at}
            texts = batch.column(where).to_pylist()
            columns = list(batch.columns)
            columns[where] = pa.array([new.get(i, x) for i, x in enumerate(texts)], columns[where].type)
            if sized >= 0:
                before = columns[sized].to_pylist()
                columns[sized] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(before)], columns[sized].type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return each

    return map_slices(docs, text, docs.schema, work)
