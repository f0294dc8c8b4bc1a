import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from factlake.llm import alignment
from factlake.llm.alignment import Aligner, ByteTokens, PieceTokens, align_documents, intersect, read_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_values():
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def plain(texts):
    """Offsets token by token, groups by sets of ends, all links one by one, counts by sets of pairs."""
    byte = byte_values()
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    rows, held, linked = [], Counter(), []
    for text in texts:
        ids = [[], []]
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            wa = [bytes(byte[c] for c in ta.id_to_token(i)) for i in a]
            wb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(wa) == b"".join(wb) == (" " + text).encode():
                ids = [list(zip(np.cumsum([len(x) for x in w]).tolist(), i, strict=True)) for w, i in ((wa, a), (wb, b))]
        ends = sorted({e for e, _ in ids[0]} & {e for e, _ in ids[1]})
        groups, low = [], 0
        for end in ends:
            groups.append([[i for e, i in side if low < e <= end] for side in ids])
            low = end
        links = [(a, b) for x, y in groups for a in x for b in y]
        held.update(set(links))
        linked.append(links)
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((len(ids[0]), len(ids[1]), len(groups), len(links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), r[4]) for r, links in zip(rows, linked, strict=True)]


def texts():
    rnd = random.Random(8)
    alphabet = ["the ", "in", "worthless ", "é", "日本", "  ", "\n", "\t", "🙂", "1234", "½", "▁", "<s>", "<|endoftext|>", "<0x41>", "ß", "zzqxj", ".", "'s", "\x00", "aaaaaaa", "​"]
    return [None, "", " ", "Hello world", "Hello world", " x", "<|endoftext|>", "ﬁ", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 40))) for _ in range(150)), "q" * 3000, "the cat " * 800]


def test_intersection_gallops_like_sets():
    rnd = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 3000), (3000, 40), (900, 1000), (5000, 5000)):
        a, b = (np.unique(rnd.integers(0, 6000, k)) for k in (n, m))
        x, y = intersect(a, b)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_chunks_of_links_are_the_links(monkeypatch):
    aligner = Aligner(ByteTokens(read_bytes(None, A).decode(), public_tokenizers.PATTERN), PieceTokens(read_bytes(None, B)))
    whole = aligner.align([t for t in texts() if t])
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 5)
    for a, b in zip(whole, aligner.align([t for t in texts() if t]), strict=True):
        assert a[:5] == b[:5]
        join = lambda x: [(int(p), int(n)) for chunk in x[5] for p, n in zip(*chunk, strict=True)]
        assert sorted(join(a)) == sorted(join(b)) and len({p for p, _ in join(b)}) == len(join(b))


def test_documents_equal_plain_alignment(spark, monkeypatch):
    """Nulls, empty, very long, repeated and unfaithful texts; null and repeated ids; clashing columns. Once with all pairs broadcast, once with nearly none."""
    rows = [(k if k % 7 else None, t, "x", 1) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n long").repartition(3)
    expected = sorted(zip([str(r[0]) for r in rows], plain([r[1] for r in rows]), strict=True))
    for share in (1 << 18, 4):
        monkeypatch.setattr(alignment, "FREQUENT_SHARE", share)
        assert sorted((str(r[0]), tuple(r[1:])) for r in align_documents(df, A, public_tokenizers.PATTERN, B).collect()) == expected
    assert align_documents(df.limit(0), A, public_tokenizers.PATTERN, B).count() == 0
    (row,) = align_documents(spark.createDataFrame([(1, "word and " * 60_000)], "doc_id long, text string"), A, public_tokenizers.PATTERN, B).collect()
    assert row["n_a"] == 120_001 and row["n_groups"] == row["n_b"]
