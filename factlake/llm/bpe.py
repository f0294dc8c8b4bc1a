"""Operator 1: byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece of text there is exactly one token that its encoding ends with.
``PrefixEncoder`` stores that token per prefix: a token t that ends at byte j is the one when t
and the last token of the prefix before it stay as they are if merged together. So bytes can be
appended without touching what is there, and words that share a beginning share its states.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.hashing import small_chunks
from factlake.llm.tables import map_rows, text_bytes

_NO_RANK = 1 << 60
#: pieces of text kept encoded per task, the longest of them in bytes, and answers on pairs of tokens kept
CACHE_PIECES, CACHE_BYTES, CACHE_PAIRS = 250_000, 48, 250_000
#: bytes of text encoded at once, and rows of an Arrow batch where the session leaves that open
CHUNK_BYTES, BATCH_ROWS = 500_000, 2_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of base64 tokens; it has as many lines as the vocabulary tokens."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").toPandas()["value"] if "://" in path else open(path).read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class PrefixEncoder:
    """Encodes byte strings; ``last`` tokens of prefixes are shared between strings in sorted order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.stays: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # steps backwards over the bytes of tokens: state * 256 + byte -> state, and the token a state spells
        self.back: dict[int, int] = {}
        self.spelt: list[int] = [-1]
        for token, rank in ranks.items():
            state = 0
            for byte in reversed(token):
                key = state << 8 | byte
                state = self.back.setdefault(key, len(self.spelt))
                if state == len(self.spelt):
                    self.spelt.append(-1)
            self.spelt[state] = rank

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, used for single tokens and pairs of them."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        own = [ranks.get(a + b, _NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while own and (least := min(own)) < _NO_RANK:
            i = own.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del own[i]
            if i < len(own):
                own[i] = ranks.get(parts[i] + parts[i + 1], _NO_RANK)
            if i:
                own[i - 1] = ranks.get(parts[i - 1] + parts[i], _NO_RANK)
        return parts

    def is_whole(self, t: int) -> bool:
        """Whether merging the bytes of token t gives t."""
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merged(self.token[t]) == [self.token[t]]
        return known

    def both_stay(self, s: int, t: int) -> bool:
        """Whether merging the bytes of s and t gives s and t."""
        known = self.stays.get(s << 24 | t)
        if known is None:
            a, b = self.token[s], self.token[t]
            known = a + b not in self.ranks and self.merged(a + b) == [a, b]
            if len(self.stays) > CACHE_PAIRS:
                self.stays.clear()
            self.stays[s << 24 | t] = known
        return known

    def extend(self, last: list[int], data: bytes) -> None:
        """Adds the last tokens of the prefixes of ``data`` that ``last`` lacks; last[0] is -1."""
        back, spelt, stays = self.back, self.spelt, self.stays
        for end in range(len(last), len(data) + 1):
            state, found = 0, -1
            for at in range(end - 1, -1, -1):
                state = back.get(state << 8 | data[at], 0)
                if not state:
                    break
                t = spelt[state]
                if t < 0:
                    continue
                if at:
                    ok = stays.get(last[at] << 24 | t)
                    if ok is None:
                        ok = self.both_stay(last[at], t)
                else:
                    ok = self.is_whole(t)
                if ok:
                    found = t
                    break
            last.append(found)

    def tokens(self, last: list[int], end: int) -> tuple[int, ...]:
        """The encoding of the prefix of ``end`` bytes, read backwards from its last token."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.token[last[end]])
        return tuple(out[::-1])

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of pieces; in sorted order each piece starts from the states it shares with the one before."""
        out, before, last = {}, b"", [-1]
        for piece in sorted(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[piece] = (rank,)
                continue
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :]
            self.extend(last, piece)
            out[piece], before = self.tokens(last, len(piece)), piece
        return out


#: In texts without any other character the classes of the pattern are these.
_COMMON_TEXT = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")
_COMMON_CLASSES = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r\x20"}


def common_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with Unicode classes written out for common texts, for the faster re; None if it holds others."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        for name, chars in _COMMON_CLASSES.items():
            if pattern.startswith(name, at):
                out, at = out + (chars if inside else f"[{chars}]"), at + len(name)
                break
        else:
            if pattern.startswith(r"\S", at) and not inside:
                out, at = out + f"[^{_COMMON_CLASSES[r'\s']}]", at + 2
                continue
            if pattern[at] == "\\":
                return None
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out, at = out + pattern[at], at + 1
    try:
        return re.compile(out)
    except re.error:
        return None


class TextEncoder:
    """Encodes texts: pieces by the pattern, each piece by a PrefixEncoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.prefix, self.pattern, self.known = PrefixEncoder(ranks), regex.compile(pattern), {}
        self.common = common_pattern(pattern)

    def split(self, text: str) -> list[str]:
        common = self.common is not None and _COMMON_TEXT.fullmatch(text)
        return (self.common if common else self.pattern).findall(text)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(text) for text in texts]
        missing = set(chain.from_iterable(split)).difference(self.known)
        found = self.prefix.encode_pieces({piece.encode() for piece in missing})
        known = self.known
        for piece in missing:
            known[piece] = found[piece.encode()]
        out = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]
        for piece in missing if len(known) > CACHE_PIECES else [p for p in missing if len(p) > CACHE_BYTES]:
            del known[piece]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.prefix.token.__getitem__, ids))


class EncodedText:
    """A text with its encoding, kept exact under appends and edits near which alone pieces are encoded anew."""

    def __init__(self, encoder: TextEncoder, text: str = "") -> None:
        self.encoder, self.text, self.pieces, self.recoded = encoder, "", [], 0
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(ids for _, _, ids in self.pieces))

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` for text[start:end]; pieces before the edit stay, those behind it once boundaries agree again."""
        moved = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        # a piece depends on its own characters and on the one behind it
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] + 1 <= start:
            keep += 1
        keep = max(0, keep - 1)
        at = self.pieces[keep][0] if keep < len(self.pieces) else (self.pieces[-1][1] if self.pieces else 0)
        behind = {a + moved: k for k, (a, _, _) in enumerate(self.pieces) if a >= end}
        middle, tail = [], []
        while at < len(text):
            if at in behind and at >= start + len(new):
                tail = [(a + moved, b + moved, ids) for a, b, ids in self.pieces[behind[at] :]]
                break
            found = self.encoder.pattern.match(text, at)
            if found is None or found.end() == at:
                at += 1
                continue
            middle.append((at, found.end()))
            at = found.end()
        codes = self.encoder.prefix.encode_pieces({text[a:b].encode() for a, b in middle})
        self.recoded += len(middle)
        self.pieces[keep:] = [(a, b, codes[text[a:b].encode()]) for a, b in middle] + tail
        self.text = text


_COLUMNS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, columns: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *columns) for every row of ``docs``, of its whole text.

    Columns: n_tokens, ids, ids_sha256 (of decimal ids joined by one space), decoded (the bytes
    that the ids stand for) and decoded_sha256. Null text is empty and has no ids. Repeated rows
    each give a row, null ids pass through, other columns are ignored, an empty table gives an
    empty result. Characters that the pattern does not match are skipped, as tokenizers do.
    The vocabulary, of a fixed size, is the only thing that is broadcast. A session that does not
    set its Arrow batch size gets BATCH_ROWS, as rows hold whole texts. Very long texts are encoded
    whole, one at a time.
    """
    if docs.sparkSession.conf.get(_BATCH_CONF, None) is None:
        docs.sparkSession.conf.set(_BATCH_CONF, BATCH_ROWS)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, vocabulary))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(ranks.value, pattern)
        decimal = {rank: str(rank) for rank in encoder.prefix.token}
        make = {
            "n_tokens": lambda ids: pa.array(map(len, ids), pa.int64()),
            "ids": lambda ids: pa.array(ids, pa.list_(pa.int32())),
            "ids_sha256": lambda ids: pa.array([hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
            "decoded": lambda ids: pa.array(map(encoder.decode, ids), pa.binary()),
            "decoded_sha256": lambda ids: pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
        }
        for batch in batches:
            for keys, texts in small_chunks(batch.column(0), batch.column(1), CHUNK_BYTES, 64):
                ids = encoder.encode_batch([t.decode("utf-8", "replace") for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(make[c](ids) for c in columns)], ["doc_id", *columns])

    return map_rows(source, run, ", ".join(["doc_id long", *(f"{c} {_COLUMNS[c]}" for c in columns)]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256"))
