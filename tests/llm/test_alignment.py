import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import ODD_ROWS, SF
from tokenizers import Tokenizer

from caseflow.llm import alignment, tables
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [*ODD_ROWS, (30, "a <|endoftext|> b <s> <0x41> </s>"), (31, "tabs\tand  blanks \n\n then\r\nmore \x0b\x0c end "), (32, " leading"), (33, "\nleading"),
       (34, "a▁b is no blank"), (35, "  no-break   em \x1c sep \x85 nel"), (36, "\x00 nul"), (37, " "), (38, "\n"), (39, "x\n"),
       (40, "ﬁ ½ Å ́ combining ZWJ 👩‍💻 𝒳 ﻿ bom"), (41, "don't we'll I'M 12 345,678.90 %%% foo...\n...bar"), (42, "trailing  "),
       (43, "the the the cat"), (43, "the the the cat"), (44, "a\t \n b \t\nc　 d  e")]


def byte_spelling():
    shown = {**{b: b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    for b in range(256):
        if b not in shown:
            shown[b] = 256 + sum(1 for x in shown.values() if x >= 256)
    back = {chr(c): b for b, c in shown.items()}
    return lambda token: bytes(back[c] for c in token)


def brute(rows):
    """(doc_id, text) rows to result rows: whole texts encoded, groups and links by walking over the bytes."""
    library, spell = Tokenizer.from_file(A), byte_spelling()
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    per_doc, corpus = [], Counter()
    for doc_id, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            whole = (" " + text).encode()
            a = library.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            spelled_a = [spell(library.id_to_token(i)) for i in a]
            names = [pieces.id_to_piece(i) for i in b]
            spelled_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
            if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
                a = b = []
            else:
                cover_a = [k for k, s in enumerate(spelled_a) for _ in s]
                cover_b = [k for k, s in enumerate(spelled_b) for _ in s]
                met = sorted(set(zip(cover_a, cover_b)))
                links = [(a[i], b[j]) for i, j in met]
                ends = [set(np.cumsum([len(s) for s in spelled]).tolist()) for spelled in (spelled_a, spelled_b)]
                edges = [0, *sorted(ends[0] & ends[1])]
                for lo, hi in zip(edges, edges[1:]):
                    groups.append(",".join(str(a[k]) for k in sorted(set(cover_a[lo:hi]))) + "|" + ",".join(str(b[k]) for k in sorted(set(cover_b[lo:hi]))))
        corpus.update(links)
        per_doc.append((doc_id, a, b, groups, links))
    top = Counter()
    for (_, y), n in corpus.items():
        top[y] = max(top[y], n)
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(corpus[p] == top[p[1]] for p in links), sum(corpus[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc_id, a, b, groups, links in per_doc]


def aligned(docs, **options):
    blocks = alignment.align(docs, A, B, **options)
    return alignment.scored(blocks, alignment.pair_counts(blocks))


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(brute(rows), key=str)


def test_table_against_whole_texts(spark):
    same(alignment.op12(spark, SF), [(r["doc_id"], r["text"]) for r in tables.read(spark, SF, "documents").collect()])


@pytest.mark.parametrize("chars", [1, 500, 1 << 20])
def test_odd_rows_in_blocks_of_any_size(spark, make, chars):
    same(aligned(make(ODD).repartition(3), block_chars=chars), [(r[0], r[1]) for r in ODD])


def test_random_texts_cut_as_whole_ones(spark, make):
    rng = random.Random(5)
    bits = [" ", " ", "\n", "  ", "\t", " ", "a", "the", "Ünï", ".", "'s", "12", "中文", "🙂", "<s>", "\r", " ", "##", "_"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for k in range(1500)]
    same(aligned(make(rows)), rows)


def test_empty_table_and_clashing_columns(spark, make, stored):
    assert alignment.op12(spark, stored([], 1)).collect() == []
    clash = make(ODD).withColumns({c: F.lit("clash") for c in ("block", "kind", "segments", "place", "a", "b", "n", "count", "best", "n_a")})
    same(aligned(clash), [(r[0], r[1]) for r in ODD])


def test_coalescing_of_any_intervals():
    rng = np.random.default_rng(3)
    starts = rng.integers(0, 400, 60)
    ends = starts + rng.integers(1, 9, 60)
    side = rng.integers(0, 2, 60)
    group = alignment.coalesce(starts, ends, side)
    near = (starts[:, None] < ends) & (starts < ends[:, None])
    for _ in range(6):
        near = near @ near
    assert ((group[:, None] == group) == near).all()


def test_vocabularies_that_do_not_break_at_blanks_are_refused():
    with pytest.raises(ValueError):
        alignment.ByteTokens(public_tokenizers.path("word_bpe_49k.json"))
