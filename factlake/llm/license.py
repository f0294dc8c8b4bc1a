"""Operator 4: license notices by fuzzy short-notice search.

A notice with at most e edits, cut in e + 1 pieces, has a piece without edits. The pieces are
searched exactly, all notices at once, and locate candidates; the regex library's bounded-error
matching verifies the notice around each and reports its span.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.hashing import WORD_SEPARATORS, small_chunks
from factlake.llm.tables import map_rows, text_bytes

# fixed values: phrases of the contract, found only exactly
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# fixed values: short notices, their labels and the edits (characters) allowed
NOTICES = (
    ("licensed under the mit license", "mit", 2),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache-2", 3),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("licensed under the gnu general public license version 3", "gpl-3", 3),
    ("licensed under the gnu general public license version 2", "gpl-2", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("licensed under the bsd license", "bsd", 2),
    ("subject to the terms of the mozilla public license", "mpl", 3),
    ("all rights reserved", "all-rights-reserved", 1),
    ("this is free and unencumbered software released into the public domain", "public-domain", 4),
)
_TO_WORDS = bytes(32 if WORD_SEPARATORS[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


class NoticeSearch:
    """Searches normalised text (words joined by one space, a space at both ends)."""

    def __init__(self, base=BASE, notices=NOTICES) -> None:
        self.rules, seeds = [], {}
        for k, (notice, label, edits) in enumerate([*((p, x, 0) for p, x in base), *notices]):
            # the text has a space at either side of a base phrase, so words stand whole
            text = f" {notice} " if k < len(base) else notice
            self.rules.append((label, edits, len(text), k < len(base), regex.compile(f"(?:{regex.escape(text)}){{e<={edits}}}", regex.BESTMATCH) if edits else None))
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.longest = max(length + edits for _, edits, length, _, _ in self.rules)

    def search(self, line: str) -> list[tuple[str, int, int, int, bool]]:
        """(label, start, end, edits, base) of every place, in order of start."""
        out, tried, spans = set(), set(), {}
        for last, (size, uses) in self.seeds.iter(line):
            for k, offset in uses:
                label, edits, length, base, pattern = self.rules[k]
                start = last - size + 1 - offset
                if pattern is None:
                    out.add((label, start, start + length, 0, base))
                    continue
                if (k, start) in tried:
                    continue  # another piece of the same place
                tried.add((k, start))
                # a notice with this piece in its place begins within the edits of start; best matches hide no others in so narrow a region
                if m := pattern.search(line, max(0, start - edits), start + length + edits):
                    spans.setdefault(k, set()).add((sum(m.fuzzy_counts), *m.span()))
        for k, found in spans.items():
            label, kept = self.rules[k][0], []
            for edits, start, end in sorted(found):  # pieces out of place can give the same notice again, cut short
                at = bisect(kept, (start, end))
                if all(2 * (min(end, e) - max(start, b)) <= min(end - start, e - b) for b, e in kept[max(0, at - 1) : at + 1]):
                    kept.insert(at, (start, end))
                    out.add((label, start, end, edits, False))
        # of overlapping notices of different labels those with more edits than another go
        better = lambda a, b: b[0] != a[0] and b[3] < a[3] and a[1] < b[2]
        ordered = sorted(out, key=lambda s: (s[1], s[2], s[0], s[4]))
        starts = [s[1] for s in ordered]
        around = lambda a: ordered[bisect_left(starts, a[1] - self.longest) : bisect_left(starts, a[2])]
        return [a for a in ordered if a[4] or not any(better(a, b) for b in around(a))]


def normalised(data: bytes) -> tuple[bytes, int]:
    """Lower-case words joined by single spaces, one at either end, and how many."""
    words = data.translate(_TO_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b"", len(words)


def _words_before(text: str, places: list[int]) -> dict[int, int]:
    """How many spaces stand before each place, counted in one pass."""
    out, n, last = {}, 0, 0
    for p in sorted(set(places)):
        n += text.count(" ", last, p)
        out[p], last = n, p
    return out


def scan_licenses(docs: DataFrame, *, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, notices array of label, first_word, last_word, edits and base) for every row.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in
    lower case; spans are numbers of words, from 0, both inclusive. Null text has no words.
    Repeated rows each give a row, null ids pass through, other columns are ignored, an empty
    table gives an empty result. Only the fixed notices are shipped; nothing is shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(base, notices)
        for batch in batches:
            for keys, raw in small_chunks(batch.column(0), batch.column(1)):
                counts, rows = [], []
                for data in raw:
                    line, n = normalised(data)
                    counts.append(n)
                    text = line.decode("latin-1")  # notices are ASCII; one character a byte is enough
                    found = [(label, max(1, a + 1), max(1, b - 1), edits, own) for label, a, b, edits, own in search.search(text)]
                    at = _words_before(text, [p for f in found for p in f[1:3]])
                    rows.append([{"label": label, "first_word": at[a] - 1, "last_word": at[b] - 1, "edits": edits, "base": own} for label, a, b, edits, own in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_words", "notices"])

    return map_rows(source, run, "doc_id long, n_words long, notices array<struct<label:string,first_word:long,last_word:long,edits:int,base:boolean>>")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("notices", lambda s: s["base"])
    names = lambda of: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))))
    best = F.array_max(F.transform("notices", lambda s: F.when(s["base"], 1.0).otherwise(1.0 / (1 + s["edits"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        names(base).alias("base_labels"),
        names("notices").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
