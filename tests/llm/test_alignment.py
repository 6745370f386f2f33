"""Alignment of two tokenizers against the libraries and a plain loop over bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cairn.llm import alignment

PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]
TEXTS = [
    None, "", " ", "a", "Hello world", "  two  spaces \n\n lines\t\ttabs ; \r\n x", "Straße ñandú 漢字 été\u0085x\x1cy <|endoftext|> <s></s> <unk> <0x0A> don't",
    "a literal ▁ mark", "x▁ y", " no break　wide", "🙂🙂 emoji é", "trailing  ", "trailing\n", "\n leading", "x" * 3000, "supercalifragilistic " * 400, "the cat sat on the mat. " * 9, "\x00 nul \x00",
]


def brute(rows):
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    out, links = [], []
    for i, t in rows:
        ids, pieces = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xs = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids]
        ys = [bytes([int(b.id_to_piece(y)[3:5], 16)]) if b.is_byte(y) else b.id_to_piece(y).replace("▁", " ").encode() for y in pieces]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            out.append((i, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [{}, {}]
        for k, (tokens, own) in enumerate(((xs, ids), (ys, pieces))):
            at = 0
            for token, number in zip(tokens, own, strict=True):
                at += len(token)
                ends[k][at] = number
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(v) for e, v in side.items() if x < e <= y) for side in ends) for x, y in zip([0, *common], common, strict=False)]
        links.append([(ends[0][e], ends[1][e]) for e in common])
        out.append((i, len(ids), len(pieces), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for ls in links for x in ls)
    top: dict = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return [(i, n_a, n_b, n, n, sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha) for (i, n_a, n_b, n, sha), ls in zip(out, links, strict=True)]


@pytest.mark.parametrize("parts", [1, 3])
def test_alignment(spark, parts):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id at all")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_links int").repartition(parts)
    assert Counter(tuple(r) for r in alignment.align_tokens(df, *PATHS).collect()) == Counter(brute(rows))


def test_texts_whose_bytes_change_have_no_tokens(spark):
    rows = alignment.align_tokens(spark.createDataFrame([(1, "a ▁ b"), (2, None), (3, "")], "doc_id long, text string"), *PATHS).collect()
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "")}


def test_nothing(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_pieces_of_long_texts_encode_alike(monkeypatch):
    own = alignment.Tokens(*PATHS)
    monkeypatch.setattr(alignment, "PIECE", 5)
    for t in filter(None, TEXTS):
        assert "".join(alignment.pieces(" " + t)) == " " + t
        a, b = own.encode(t)
        whole = own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t)
        assert (a, b) in (whole, ([], [])) and ("▁" in t) == (not a)
