"""SentencePiece encoding with seeded merge-dropout, and decoding.

The text is split into units that no merge crosses, and the units are merged as
ragged arrays: in each round a unit looks at all its candidate merges (its
agenda), skips each by a keyed hash with probability ``dropout``, and applies
the best that is left.  A unit whose whole agenda is skipped is done.  The key
is (seed, document id, number of the unit in the text, place, pair, round), so a
segmentation is repeatable anywhere, and every occurrence of a word is drawn by
itself.  Decoding gives the text back exactly: what the vocabulary lacks, and a literal word mark, is coded
as bytes.  With dropout 0 the ids equal the library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorecraft.llm.common import ragged_index, segment_sums, slices
from scorecraft.llm.ragged_bpe import PairTable, merge
from scorecraft.llm.text_hash import mix, seeded
from scorecraft.llm.token_counts import chunks

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
MARK = "▁"
STAND_IN = "\udc00"
# Units are merged in groups of about this many characters, whatever the length of a text.
MERGE_CHARS = 1 << 17
DIGEST_BASE = np.uint64(0x100000001B3)


class PieceCoder:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = {model.id_to_piece(i): i for i in range(n)
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # Symbols: piece ids, then one for every other character (it merges with nothing).
        self.chars = {p: i for p, i in plain.items() if len(p) == 1}
        self.other = n
        score = {i: model.get_score(i) for i in plain.values()}
        by_score = {i: k for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))}
        rows = [(plain[p[:k]], plain[p[k:]], by_score[i], i) for p, i in plain.items() for k in range(1, len(p))
                if p[:k] in plain and p[k:] in plain]
        self.table = PairTable(*(zip(*rows, strict=True) if rows else ((),) * 4), n + 1)
        # Space and line ends bound a unit: no piece holds one after another character.
        inner = {c for p in plain for a, c in zip(p, p[1:], strict=False) if c == MARK != a}
        if inner or "\n" in self.chars:
            raise ValueError("this model merges across word marks or line ends")
        self.dropout = int(dropout * (1 << 32))
        self.seed = seed
        self.code = np.full(0x110000, self.other, np.int32)
        for c, i in self.chars.items():
            self.code[ord(c)] = i
        shown = [b""] * n
        for p, i in plain.items():
            shown[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            shown[i] = bytes([b])
        self.shown_len = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _segment(self, points: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge units, given as characters one after the other, each under its own key."""
        symbols = self.code[points].astype(np.int64)
        drop = None
        if self.dropout:
            def drop(seq, place, pair, turn):
                h = mix(owner[seq] + (place.astype(np.uint64) << np.uint64(32)) + pair.astype(np.uint64)
                        + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
                return (h >> np.uint64(32)) < np.uint64(self.dropout)

        ids, counts = merge(self.table, symbols, lengths, drop)
        if (ids == self.other).any():
            ids, counts = self._bytes_for(ids, counts, points[symbols == self.other])
        return ids, counts

    def _bytes_for(self, ids, counts, points) -> tuple[np.ndarray, np.ndarray]:
        """Replace every symbol without a piece by its UTF-8 bytes."""
        missing = [(MARK if c == ord(STAND_IN) else chr(c)).encode() for c in points.tolist()]
        size = np.ones(len(ids), np.int64)
        size[ids == self.other] = [len(b) for b in missing]
        out = np.repeat(ids, size)
        out[out == self.other] = self.byte_ids[np.frombuffer(b"".join(missing), np.uint8)]
        return out, segment_sums(size, counts)

    def encode(self, texts: list[str], doc_ids: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        # a literal mark is no space: a stand-in that no UTF-8 text can hold keeps it apart
        marked = [(" " + t).replace(MARK, STAND_IN).replace(" ", MARK) if t else "" for t in texts]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not points.size:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        ends = np.cumsum(size)
        # a unit is a line end, or a run of marks with what follows up to the next mark or line end
        mark, line = points == ord(MARK), points == ord("\n")
        lead = line | mark
        lead[1:] = line[1:] | line[:-1] | mark[1:] & ~mark[:-1]
        lead[(ends - size)[size > 0]] = True
        at = np.append(np.flatnonzero(lead), points.size)
        text = np.searchsorted(ends, at[:-1], side="right")
        of_text = np.bincount(text, minlength=len(texts))
        place = ragged_index(np.zeros(len(texts), np.int64), of_text).astype(np.uint64)
        base = mix(np.asarray(doc_ids, np.int64).view(np.uint64) + seeded(self.seed))
        owner = mix(base[text] + place)
        done = [self._segment(points[at[a]:at[b]], np.diff(at[a:b + 1]), owner[a:b]) for a, b in slices(at, MERGE_CHARS)]
        ids, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids, segment_sums(counts, of_text)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of every text: pieces joined, the leading space of the first piece removed."""
        size = self.shown_len[ids]
        data = self.shown[ragged_index(self.shown_at[ids], size)].tobytes()
        ends = np.cumsum(segment_sums(size, counts))
        out, at = [], 0
        for e in ends.tolist():
            out.append(data[at + 1:e] if e > at else b"")
            at = e
        return out


def _doc_ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_pieces(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids array<int>, decoded string, lossless boolean: one row per input row, no shuffle.

    ``decoded`` is made from the ids alone.  NULL and empty texts have no ids
    and decode to the empty text (lossless); a NULL doc_id stays NULL and is
    drawn as -1; repeated rows get the same segmentation; an empty table gives
    no rows; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _runner(model, dropout, seed, digest=False),
        "doc_id long, ids array<int>, decoded string, lossless boolean")


def piece_digest(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """The same rows with ids and text as digests: doc_id, n_pieces, ids_digest, n_decoded_bytes, lossless."""
    return docs.select("doc_id", "text").mapInArrow(
        _runner(model, dropout, seed, digest=True),
        "doc_id long, n_pieces long, ids_digest long, n_decoded_bytes long, lossless boolean")


def _runner(model: str, dropout: float, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = PieceCoder(public_tokenizers.path(model), dropout, seed)
        for batch in batches:
            which = _doc_ids(batch.column("doc_id"))
            at = 0
            for group in chunks(x.as_py() for x in batch.column("text")):
                ids, counts = coder.encode(group, which[at:at + len(group)])
                back = coder.decode(ids, counts)
                same = pa.array([b == t.encode() for b, t in zip(back, group, strict=True)], pa.bool_())
                who = batch.column("doc_id").slice(at, len(group)).cast(pa.int64())
                at += len(group)
                if digest:
                    place = ragged_index(np.zeros(len(counts), np.int64), counts).astype(np.uint64) + np.uint64(1)
                    sums = segment_sums(mix(place * DIGEST_BASE + ids.astype(np.uint64)), counts)
                    cols = {"doc_id": who, "n_pieces": pa.array(counts), "ids_digest": pa.array(sums.view(np.int64)),
                            "n_decoded_bytes": pa.array([len(b) for b in back], pa.int64()), "lossless": same}
                else:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    cols = {"doc_id": who, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))),
                            "decoded": pa.array([b.decode("utf-8", "replace") for b in back], pa.string()), "lossless": same}
                yield pa.RecordBatch.from_pydict(cols)

    return run
