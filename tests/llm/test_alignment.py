from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from scorebook.llm import alignment

LETTERS = alignment._byte_letters()


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECES}")


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def tokens_of(text, tokenizers):
    a, b = tokenizers
    if not text:
        return [], []
    whole = b" " + text.encode()
    left = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()) for i in b.encode(text)]
    if any(b"".join(t for _, t in side) != whole for side in (left, right)):
        return [], []
    return spans(left), spans(right)


def groups(left, right):
    ends = sorted({e for *_, e in left} & {e for *_, e in right})
    out, start = [], 0
    for end in ends:
        part = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (left, right)]
        out.append("|".join(part))
        start = end
    return out


def plain(rows, tokenizers):
    found = []
    for i, text in rows:
        left, right = tokens_of(text, tokenizers)
        links = [(a, b) for a, s, e in left for b, t, f in right if s < f and t < e]
        found.append((i, left, right, groups(left, right), links))
    counts = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, left, right, parts, links in found:
        digest = sha256(";".join(parts).encode()).hexdigest() if left else ""
        n_best = sum(counts[k] == best[k[1]] for k in links)
        out.append((i, len(left), len(right), len(parts), len(links), digest, n_best, sum(counts[k] for k in links)))
    pairs = [(a, b, len([1 for *_, x in found if (a, b) in x]), n, n == best[b]) for (a, b), n in counts.items()]
    return sorted(out, key=repr), sorted(pairs)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


ODD = [
    None, "", " ", "  two  spaces ", "a", "\n\n\t x", "<|endoftext|> and <s> </s> <unk> <0x41>", "\u2581 piece mark", "naïve café Ünïcode",
    "日本語のテキスト と 中文", "emoji 👩\u200d👩\u200d👧 flags 🇯🇵", "don't we'll I'M 12345678 3.14 --- ...", "\u00a0hard\u3000wide", "e\u0301 combining",
    "\x00 nul \x07 bell", "ﬁ ligature ① ½", "word " * 300, "x" * 700,
]


@pytest.mark.parametrize("block_chars", [4 << 20, 300])
def test_alignment_equals_plain_loops(spark, tokenizers, block_chars):
    r = random.Random(6)
    rows = list(enumerate(ODD)) + [(100 + i, prose(r, r.randint(1, 60))) for i in range(60)] + [(100, "again"), (None, "word one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, pairs = plain(rows, tokenizers)
    assert got(alignment.find(df, block_chars=block_chars)) == want
    assert sorted(tuple(x) for x in alignment.pairs(df, block_chars=block_chars).select("a", "b", "n_docs", "n_links", "best").collect()) == pairs


def test_both_tokenizers_split_texts_as_their_own_libraries_do(tokenizers):
    a, b = alignment.vocabularies(*[open(f"{alignment.FOLDER}/{n}", "rb").read() for n in (alignment.BYTE_LEVEL, alignment.PIECES)])
    r = random.Random(2)
    letters = "abcXYZ 012.,'\n\t ßéЖ漢字🙂\u2581-_ " + "s t re ll "
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 80)))
        assert a.encode(text) == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert b.encode(text) == tokenizers[1].encode(text)


def test_bitmaps_give_back_their_rows_and_planes_their_multiplicities():
    r = np.random.default_rng(4)
    n_rows = 500
    pairs = r.choice([3, 9 << 16 | 4, 7 << 16 | 4, 50_000 << 16 | 31_999], 9000, p=[0.6, 0.3, 0.0995, 0.0005])
    rows = r.integers(0, n_rows, 9000)
    want = Counter(zip(pairs.tolist(), rows.tolist()))
    found, plain_bits = Counter(), 0
    for plane, some, counts, bits in alignment.postings(rows, pairs, n_rows):
        at, back = alignment.unpacked(bits, counts)
        plain_bits += sum(len(x.as_py()) == (n_rows + 7) // 8 for x in bits)
        for k, row in zip(at.tolist(), back.tolist()):
            found[(int(some[k]), row)] += 1 if plane == 0 else 1 << (plane - 1)
    assert found == want and plain_bits > 2
    none = alignment.unpacked(pa.array([], pa.binary()), np.zeros(0, np.int64))
    assert [len(x) for x in none] == [0, 0]


def test_long_texts_empty_tables_and_clashing_names(spark, empty, clashing, docs):
    long = prose(random.Random(1), 120_000)
    found = got(alignment.find(spark.createDataFrame([(1, long), (2, "w" * 200_000)], "doc_id long, text string")))
    assert found[0][4] == found[0][1] + found[0][2] - found[0][3] and found[0][3] > 100_000 and found[1][1] > 0
    assert alignment.find(empty).count() == 0
    assert got(alignment.find(clashing)) == got(alignment.find(docs))
