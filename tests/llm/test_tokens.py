"""Token counts and pieces against the tokenizer libraries, and exact round trips."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scorecraft.llm.pieces import PieceCoder, encode_pieces, piece_digest
from scorecraft.llm.token_counts import TokenCounter, token_counts

PARTS = ["a", "b", "'s", "'ll", " ", "\n", "\t", "é", "é", "ΑΣ", "Σ", "İ", "\u0085", "\x1c", "\u3000", "<|endoftext|>", "<|endof", "12",
         "½", "日本", "!!", "</w>", "ab", "th", "the", "\x00", "🙂", "\u200d", "A", "aaaa", "Ⅷ", "²", "  ", "<s>", "<0x0A>"]
TABLE = [(1, "Plain text, it's here."), (2, None), (3, ""), (None, "no id"), (4, "x" * 3000), (1, "Plain text, it's here."),
         (5, "mark \u2581 here\u2581\u2581 \U0001f642\n\n  two"), (6, "word " * 2100)]


def noise(n: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = noise(1500) + [t or "" for _, t in TABLE]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(P.path("word_bpe_49k.json")).count(texts).tolist() == want


def test_pieces_without_dropout_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = noise(1500)
    ids, counts = PieceCoder(P.path("piece_bpe_32k.model"), 0.0).encode(texts, [0] * len(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)


def test_dropout_is_lossless_seeded_and_varied():
    path = P.path("piece_bpe_32k.model")
    texts = noise(800) + ["a \u2581 b", "\udfff".encode("utf-8", "replace").decode(), "international representation " * 20]
    runs = [PieceCoder(path, 0.2, seed).encode(texts, [1] * len(texts)) for seed in (1, 1, 2)]
    coder = PieceCoder(path, 0.2, 1)
    assert [b.decode() for b in coder.decode(*runs[0])] == texts
    assert np.array_equal(runs[0][0], runs[1][0]) and not np.array_equal(runs[0][0], runs[2][0])
    one, other = (coder.encode([texts[-1]], [v])[0] for v in (0, 3))
    assert not np.array_equal(one, other)


def test_every_occurrence_is_drawn_by_itself():
    path = P.path("piece_bpe_32k.model")
    coder, word, n = PieceCoder(path, 0.1, 1), "representation", 400

    def cuts(doc):
        ids, _ = coder.encode([f"{word} " * n], [doc])
        shown = [bytes(coder.shown[a:a + k]) for a, k in zip(coder.shown_at[ids], coder.shown_len[ids], strict=True)]
        return [tuple(x.split(b"|")) for x in b"|".join(shown).split(b"| ")[:n]]

    docs = [cuts(d) for d in range(40)]
    assert len(set(docs[0])) > 4 and len({c for d in docs for c in d}) > len(set(docs[0]))  # grows with the data
    assert len({tuple(d) for d in docs}) == len(docs)
    # alike in any grouping, and from any place in a group
    texts = [f"{word} {k} " * 30_000 if k == 1 else f"{word} {k}" for k in range(6)]
    ids, counts = coder.encode(texts, list(range(6)))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(np.array_equal(parts[k], coder.encode([texts[k]], [k])[0]) for k in range(6))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "clash") for i, t in TABLE], "doc_id long, text string, n_tokens int, ids string")


def test_queries_keep_every_row(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(map(tuple, token_counts(docs).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TABLE]
    assert got == sorted(((*w, w[2] > 2048) for w in want), key=repr)
    rows = encode_pieces(docs).collect()
    assert len(rows) == len(TABLE) and all(r["lossless"] for r in rows)
    assert sorted(r["decoded"] for r in rows) == sorted(t or "" for _, t in TABLE)
    digest = piece_digest(docs).collect()
    assert sorted((r["n_pieces"], r["n_decoded_bytes"]) for r in digest) == sorted((len(r["ids"]), len(r["decoded"].encode())) for r in rows)
    for f in (token_counts, encode_pieces, piece_digest):
        assert f(docs.limit(0)).count() == 0


def test_every_kind_of_letter_counts_as_in_the_library():
    """Code points that Python's modules and the library know from unlike Unicode versions, and a share of all others."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from scorecraft.llm.token_counts import TokenCounter, library_letters

    path = public_tokenizers.path("word_bpe_49k.json")
    odd, lower = library_letters(path)
    points = sorted(set(range(1, 0x800)) | set(list(odd)[::5]) | set(lower) | {0x558, 0x88F, 0x1E6F3, 0xA7CB, 0xA7DC} | set(range(0x800, 0x110000, 97)))
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    library, counter = Tokenizer.from_file(path), TokenCounter(path)
    texts = ["".join(form.format(chr(c)) for c in points[at:at + 16]) for at in range(0, len(points), 16) for form in ("a{}'s ", "a{}a ", "1{}! ")]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, counter.count(texts), want, strict=True) if g != w] == []


def test_long_texts_beyond_ascii_are_searched_once_for_rare_code_points():
    """Measured on a million code points: 14 s with the points one by one, 0.05 s with ranges."""
    import time

    from scorecraft.llm.token_counts import library_letters

    path = P.path("word_bpe_49k.json")
    odd, lower = library_letters(path)
    counter = TokenCounter(path)
    assert {c for c in range(0x110000) if counter.rare.match(chr(c))} == odd.keys() | lower.keys()
    text = "é ab " * 100_000
    began = time.process_time()
    n = counter.count([text, text + chr(min(odd)), text + chr(max(lower))]).tolist()
    assert time.process_time() - began < 5
    library = Tokenizer.from_file(path)
    assert n == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, text + chr(min(odd)), text + chr(max(lower)))]
