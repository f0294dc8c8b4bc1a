"""Operator 3: personal data. Regular expressions propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are kept whenever their own rule holds. Further kinds (iban,
ssn, and numbers named in the text as phone or account numbers) are kept from a score on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.hashing import small_chunks
from factlake.llm.tables import map_rows, pieces, text_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "account")
#: characters before a span in which context words count, and the score from which further kinds are kept
CONTEXT_CHARS, LEAST_SCORE = 48, 0.6

# fixed values: proposals
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{8,12}(?![0-9A-Za-z.-])")
_DIGIT = re.compile(r"[0-9]")

# fixed values: characters of an IBAN by country
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}

# fixed values: score of a valid span without context, words that raise it, words that lower it
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "account": 0.2}
_RAISE = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "account": ("account", "iban", "bank", "konto", "cuenta", "compte"),
}
_LOWER = ("version", "order", "invoice", "isbn", "example", "test", "sample")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid IBANs: a proposal is cut to its country's length, in other countries to the longest run of whole groups that is valid."""
    at = 0
    while found := _IBAN.search(text, at):
        start, at = found.start(), found.start() + 4
        ends, count, size = [], 0, _IBAN_LENGTHS.get(found.group()[:2])
        for k in range(start, found.end()):
            count += text[k] != " "
            if text[k] != " " and (k + 1 == len(text) or not text[k + 1].isalnum()) and (count == size if size else count >= 15):
                ends.append(k + 1)
        for end in reversed(ends):
            if mod97(text[start:end].replace(" ", "")):
                yield start, end
                at = end
                break


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, found from each @: the local part is the run before it, not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind, then start; proposals that fail their check are dropped without another try."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def context_score(text: str, kind: str, start: int) -> float:
    words = set(_WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower()))
    score = _PRIOR[kind] + 0.3 * bool(words.intersection(_RAISE[kind])) - 0.3 * bool(words.intersection(_LOWER))
    return round(min(1.0, max(0.0, score)), 3)


def all_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Base spans, then those of the further kinds that reach the score and overlap no span before them."""
    base = base_spans(text)
    out = [(kind, a, b, context_score(text, kind, a)) for kind, a, b in base]
    if not _DIGIT.search(text):
        return out
    starts, ends = [], []  # of what is taken, in order, without overlaps
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    numbers = (m.span() for m in _SSN.finditer(text) if (s := m.group())[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    for kind, places in (("iban", ibans(text)), ("ssn", numbers), ("account", (m.span() for m in _ACCOUNT.finditer(text)))):
        for a, b in places:
            at = bisect_right(ends, a)
            if (score := context_score(text, kind, a)) >= LEAST_SCORE and (at == len(starts) or starts[at] >= b):
                out.append((kind, a, b, score))
                starts.insert(at, a)
                ends.insert(at, b)
    return out


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span as its kind in angle brackets; of overlapping spans the parts are covered once."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def find_pii(docs: DataFrame, *, redact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of kind, start, end and score) and, if asked, redacted text, for every row.

    Offsets are code points of the whole text, ends exclusive. Null text is empty and has no
    spans; null ids pass through; repeated rows each give a row; other columns are ignored; an
    empty table gives an empty result. Work is per row, so nothing is shuffled or gathered.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, raw in small_chunks(batch.column(0), batch.column(1)):
                texts = [t.decode("utf-8", "replace") for t in raw]
                spans = [all_spans(t) for t in texts]
                rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in spans]
                columns = [pa.array(keys, pa.int64()), pa.array(rows, kind)]
                if redact:
                    columns.append(pa.array([redacted(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "text"][: len(columns)])

    return map_rows(source, run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>" + ", text string" * redact)


def redact_documents(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with found spans replaced in the text and its length, if there is such a column, set anew."""
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            new = [t and redacted(t, all_spans(t)) for t in texts]
            if length >= 0:
                old = columns[length].to_pylist()
                columns[length] = pa.array([n if a == b else len(b) for n, a, b in zip(old, texts, new, strict=True)], columns[length].type)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_rows(docs, run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    return found.select(
        "doc_id",
        *(count(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"),
    )
