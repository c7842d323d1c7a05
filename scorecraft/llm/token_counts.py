"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged NumPy array of byte symbols.  Each round, all
sequences apply their own lowest-rank pair at the same time; the symbols that
survive are counted.  The counts equal the tokenizer library's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scorecraft.llm.common import CHUNK_BYTES, segment_sums
from scorecraft.llm.ragged_bpe import PairTable, merge

TOKENIZER = "word_bpe_49k.json"
OVER_LIMIT = 2048
# Pre-tokens whose counts a task remembers.
MEMO_WORDS = 300_000
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in set(shown) else next(hidden) for b in range(256)]


class Memo(dict):
    """Numbers keys in order of arrival; those not yet worked on are in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = at = len(self)
        self.new.append(key)
        return at


def char_class(points: Iterable[int]) -> str:
    """A pattern for one of the code points, as ranges: those beyond U+FFFF are tried one after the other at every character of a text."""
    runs: list[list[int]] = []
    for c in sorted(points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\U{first:08x}-\U{last:08x}" for first, last in runs) + "]"


@cache
def library_letters(path: str) -> tuple[dict[int, str], dict[int, str]]:
    """Code points that the library cuts, and those that it lower-cases, otherwise than Python's modules, which know another Unicode version.

    The first with a stand-in of the library's class (letter, number, white space, other), the second with the library's lower case.
    All code points of the planes that hold letters are put to the library once; the planes 4 to 13 hold no
    characters, 15 and 16 private ones, which are letters to nobody.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ours = TokenCounter(path, ({}, {}))
    odd, lower = {}, {}
    points = [c for c in (*range(0x80, 0x40000), *range(0xE0000, 0xE1000)) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        part = points[at:at + 4096]
        # lower case: points that combine or break are told apart by what stands between
        shown = library.normalizer.normalize_str("".join(f"0{chr(c)}" for c in part) + "0").split("0")[1:-1]
        for c, x in zip(part, shown, strict=True):
            if x != ours.lower(chr(c)) and len(x) == 1 and not x.isspace():
                lower[c] = x
        cells, place = [], {}
        for c in part:
            place[len(cells) * 4] = c
            cells.append(f"a{chr(c)}!\n")
        text = "".join(cells)
        kind = {c: " " for c in part}
        for _, (start, end) in library.pre_tokenizer.pre_tokenize_str(text):
            c = place[start // 4 * 4]
            inside = start % 4
            if inside == 0 and end - start == 2:
                kind[c] = "a"
            elif inside == 1 and end - start == 2:
                kind[c] = "!"
            elif inside == 1 and end - start == 1:
                kind[c] = "0"
        mine = {c: " " for c in part}
        for m in ours.pattern.finditer(text):
            c = place[m.start() // 4 * 4]
            inside, size = m.start() % 4, m.end() - m.start()
            if inside == 0 and size == 2:
                mine[c] = "a"
            elif inside == 1:
                mine[c] = "!" if size == 2 else "0"
        odd |= {c: kind[c] for c in part if kind[c] != mine[c]}
    return odd, lower


class TokenCounter:
    """Counts tokens of texts as the library's ``encode`` gives them, without added special tokens."""

    def __init__(self, path: str, letters_of: tuple[dict[int, str], dict[int, str]] | None = None):
        self.odd, self.lowered = letters_of if letters_of is not None else library_letters(path)
        rare = self.odd.keys() | self.lowered.keys()
        self.rare = re.compile(char_class(rare)) if rare else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)),
                               [vocab[a + b] for a, b in pairs], max(vocab.values()) + 1)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + END] for c in letters], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # white space is one blank to the library; here it only has to separate
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.ascii = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
                                .replace(r"\s\p{L}\p{N}", r" \t-\ra-z0-9"))
        self.memo = Memo()
        self.counts = np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if self.rare is None or not self.rare.search(text):
            return self.pattern.findall(self.lower(text))
        text = self.lower(text.translate(self.lowered))
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.odd))]

    @staticmethod
    def lower(text: str) -> str:
        # each letter by itself: no special form of sigma at the end of a word
        return text.replace("Σ", "σ").lower()

    def learn(self, words: list[str]) -> None:
        """Merge all new pre-tokens together and remember their numbers of symbols."""
        coded = [w.encode() for w in words]
        lengths = np.array([len(b) for b in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        self.counts = np.concatenate([self.counts, merge(self.table, symbols, lengths)[1]])

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.counts = Memo(), np.zeros(0, np.int64)
        extra = np.zeros(len(texts), np.int64)
        lengths = np.zeros(len(texts), np.int64)
        index = []
        for k, text in enumerate(texts):
            if self.special is not None and "<|" in text:
                pieces = self.special.split(text)
                extra[k], words = len(pieces) - 1, [w for p in pieces for w in self.split(p)]
            else:
                words = self.split(text)
            lengths[k] = len(words)
            index.append(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)))
        if self.memo.new:
            self.learn(self.memo.new)
            self.memo.new = []
        return extra + segment_sums(self.counts[np.concatenate(index)], lengths) if index else extra


def chunks(texts: Iterator[str | None], target: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """Texts in groups of about ``target`` characters; NULL counts as empty."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= target:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, over: int = OVER_LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``over``).

    A narrow map without shuffle.  A NULL text counts as empty (0 bytes, 0
    tokens); a NULL doc_id, ties and repeated rows keep one output row each; an
    empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    letters_of = docs.sparkSession.sparkContext.broadcast(library_letters(public_tokenizers.path(tokenizer)))  # some thousand code points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(public_tokenizers.path(tokenizer), letters_of.value)
        for batch in batches:
            texts = batch.column("text")
            sizes, counts = [], []
            for group in chunks(x.as_py() for x in texts):
                sizes += [len(t.encode()) for t in group]
                counts.append(counter.count(group))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > over)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
