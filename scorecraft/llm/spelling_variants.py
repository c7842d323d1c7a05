"""Spelling variants: words one edit apart, found with FM-indexes in both directions.

Of two words one edit apart, one half of the query stands unchanged at the start or the
end of the other word.  So a query is searched twice: its first half is matched exactly
from the left and extended to the right allowing one error, and its second half
from the right, extended to the left.  Both searches are backward steps over the
suffix ranks of the delimited vocabulary: leftward over the text itself,
rightward over its mirror image.  An extension step narrows the interval of
suffix ranks to those that the next letter precedes.

Words are dealt to shards by the halves they can be found by, so that a query is
answered by the shards of its own two halves; a shard holds a bounded number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import ragged_index, stored
from scorecraft.session import bounded_broadcast

SHARD = 32_768
# Queries searched at once, and their letters with padding.
BATCH, CELLS = 8_192, 1 << 20
END, MARK = 0, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"


# ---- index -------------------------------------------------------------------------------

def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``codes`` in order (prefix doubling; the last code is the only END)."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[:max(0, n - k)] |= codes[k:].astype(np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        step *= 2


class FmIndex:
    """Suffix ranks of ``MARK word MARK word ... MARK END`` and one backward step for many intervals at once."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        """``codes``: letters (2 and above) of all words; ``offsets``: n + 1 starts of the words."""
        lengths = np.diff(offsets)
        self.starts = offsets[:-1] + np.arange(len(lengths))  # of the mark before each word
        text = np.full(len(codes) + len(lengths) + 2, MARK, np.int64)
        text[-1] = END
        text[ragged_index(self.starts + 1, lengths)] = codes
        self.n = len(text)
        self.order = suffix_order(text)
        self.before = text[self.order - 1]  # the letter before each suffix; END before the first
        by = np.argsort(self.before, kind="stable")
        self.places = self.before[by] * (self.n + 1) + by
        self.letters = np.unique(codes)

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes that begin with ``letter`` and go on with a suffix ranked in [low, high).

        Letters before suffixes stand in ``places`` in order of letter, then rank: the number of smaller ones
        is the new rank.
        """
        base = letter.astype(np.int64) * (self.n + 1)
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) pairs worth a step: those read off short intervals, all letters for long ones."""
        size = high - low
        short = size <= len(self.letters)
        at = np.flatnonzero(short)
        who = np.repeat(at, size[at])
        letter = self.before[ragged_index(low[at], size[at])]
        real = letter > MARK
        key = np.unique(who[real] * (int(self.letters[-1]) + 1) + letter[real]) if len(self.letters) else np.zeros(0, np.int64)
        wide = np.flatnonzero(~short)
        width = int(self.letters[-1]) + 1 if len(self.letters) else 1
        return (np.concatenate([key // width, np.repeat(wide, len(self.letters))]),
                np.concatenate([key % width, np.tile(self.letters, len(wide))]))

    def words_at(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, word) of every suffix in the intervals, each of which begins with a word's mark."""
        who = np.repeat(np.arange(len(low)), high - low)
        return who, np.searchsorted(self.starts, self.order[ragged_index(low, high - low)])


def one_error(index: FmIndex, queries: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for all words one edit away within the letters after the first ``exact`` ones.

    ``queries`` has one row of codes per query in the order of the steps (the
    reverse of the order they are read in the index's text).
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(queries)
    q = np.arange(n)
    low, high = index.step(np.full(n, MARK), np.zeros(n, np.int64), np.full(n, index.n))
    for p in range(int(exact.max()) if n else 0):
        go = np.flatnonzero(exact[q] > p)
        low[go], high[go] = index.step(queries[q[go], p], low[go], high[go])
        live = high > low
        q, low, high = q[live], low[live], high[live]
    # one[i]: states with an error, none[i]: without; each (query, next letter's place, interval)
    none = (q, exact[q].astype(np.int64), low, high)
    one = tuple(np.zeros(0, np.int64) for _ in range(4))
    while len(none[0]) or len(one[0]):
        new: list[tuple] = []
        q, at, low, high = one
        # states with an error: the next letter, or the mark after the last one
        done = at == lengths[q]
        letter = np.where(done, MARK, queries[q, np.minimum(at, queries.shape[1] - 1)])
        low, high = index.step(letter, low, high)
        live = high > low
        if (live & done).any():
            hit = live & done
            who, word = index.words_at(low[hit], high[hit])
            found.append((q[hit][who], word))
        live &= ~done
        new.append((q[live], at[live] + 1, low[live], high[live]))
        # states without: each letter that may come as an inserted or replaced one, the next letter left out, or matched
        q, at, low, high = none
        has = at < lengths[q]
        nxt = np.where(has, queries[q, np.minimum(at, queries.shape[1] - 1)], MARK)
        who, letter = index.letters_before(low, high)
        other = letter != nxt[who]  # the same letter inserted counts where the run of it ends
        who, letter = who[other], letter[other]
        lo, hi = index.step(letter, low[who], high[who])
        live = hi > lo
        who, lo, hi = who[live], lo[live], hi[live]
        new.append((q[who], at[who], lo, hi))
        swap = has[who]
        new.append((q[who][swap], at[who][swap] + 1, lo[swap], hi[swap]))
        new.append((q[has], at[has] + 1, low[has], high[has]))
        lo, hi = index.step(nxt[has], low[has], high[has])
        live = hi > lo
        none = (q[has][live], at[has][live] + 1, lo[live], hi[live])
        one = tuple(np.concatenate(c) for c in zip(*new, strict=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the n + 1 starts."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)


def near_in_shard(words: list[str], asked: np.ndarray, leftward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) places of distinct ``words``: for each asked one those one edit away in the half searched last.

    ``leftward``: the second half matches exactly and the first takes the error;
    else the other way round, over the mirrored words.
    """
    points, offsets = _coded(words)
    distinct, codes = np.unique(points, return_inverse=True)
    codes = codes.astype(np.int64) + MARK + 1
    lengths = np.diff(offsets)
    mirrored = np.empty_like(codes)
    ends = np.repeat(offsets[:-1] + offsets[1:] - 1, lengths)
    mirrored[ends - np.arange(len(codes))] = codes
    text, steps = (codes, mirrored) if leftward else (mirrored, codes)
    index = FmIndex(text, offsets)
    who, word = [], []
    asked = asked[np.argsort(lengths[asked], kind="stable")]  # like lengths together; a batch has a bounded number of cells
    at = 0
    while at < len(asked):
        wide = np.arange(1, min(BATCH, len(asked) - at) + 1) * lengths[asked[at:at + BATCH]]
        some = asked[at:at + max(1, int(np.searchsorted(wide, CELLS, side="right")))]
        at += len(some)
        size = lengths[some]
        rows = np.zeros((len(some), max(1, int(size.max()))), np.int64)
        filled = np.repeat(np.arange(len(some)), size), ragged_index(np.zeros(len(some), np.int64), size)
        rows[filled] = steps[ragged_index(offsets[some], size)]
        half = size // 2
        q, w = one_error(index, rows, size, size - half if leftward else half)
        who.append(some[q])
        word.append(w)
    who, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, word))
    pair = np.unique(who * len(words) + word)
    return pair // max(1, len(words)), pair % max(1, len(words))


# ---- words -------------------------------------------------------------------------------

def word_counts(docs: DataFrame, every: int = 199, least_length: int = 6, least: int = 5) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, of ``least_length`` code points and ``least`` occurrences at least.

    An occurrence whose crc32 of ``doc_id:run`` is divisible by ``every`` loses one code point (the one at crc32 modulo the
    length).  A NULL text has no words; a NULL doc_id stands as empty in the hash.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    n = F.char_length("run")
    at = (F.col("h") % n).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))
    # shorter runs cannot count whatever happens to them
    hashed = runs.where(n >= least_length).withColumn("h", h)
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


def _postings(words: DataFrame) -> DataFrame:
    """(side, key, word, n, asked): a word under every half that a query one edit away can have in common with it.

    A query of m letters has a first half of m div 2, and its neighbours m - 1 to m + 1 letters; ``asked`` marks a word's own
    half.  Words of one letter have no first half and meet under the empty one.
    """
    size = F.char_length("word")
    own = F.floor(size / 2).cast("int")
    firsts = F.array_distinct(F.array(F.floor((size - 1) / 2).cast("int"), own, F.floor((size + 1) / 2).cast("int")))
    lasts = F.array_distinct(F.array(*[(size + d - F.floor((size + d) / 2)).cast("int") for d in (-1, 0, 1)]))
    left = F.transform(firsts, lambda m: F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), m).alias("key"), (m == own).alias("asked")))
    right = F.transform(lasts, lambda m: F.struct(F.lit(1).alias("side"), F.when(m < 1, "").otherwise(
        F.substring("word", -m, m)).alias("key"), (m == size - own).alias("asked")))
    return words.select("word", "n", F.explode(F.concat(left, right)).alias("p")).select(
        "p.side", F.concat(F.char_length("p.key").cast("string"), F.lit(":"), "p.key").alias("key"), "word", "n", "p.asked")


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n), each pair of ``words`` (word, n; distinct) that differ by exactly one edit, in both directions.

    Shards hold about ``shard`` postings; a half that more words have in common than that is
    split, and its queries go to all of its parts.
    """
    posted = stored(_postings(words), "variants-postings")
    n_shards = max(1, -(-posted.count() // shard))
    hot = (posted.groupBy("side", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shard)
           .select("side", "key", F.ceil(F.col("c") / shard).cast("int").alias("parts")))
    hot, _ = bounded_broadcast(stored(hot, "variants-hot"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts.cast("long")).cast("int")
    # a word lies in its part of the half; if asked, it is sent to the other parts as a query alone
    to = F.when(F.col("asked"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    dealt = (posted.join(hot, ["side", "key"], "left").withColumn("own", own).withColumn("part", F.explode(to))
             .select("side", F.pmod(F.xxhash64("side", "key", "part"), F.lit(n_shards)).cast("int").alias("shard"),
                     "word", "n", "asked", (F.col("part") == F.col("own")).alias("listed")))

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        # a word can be here under two halves
        rows = rows.group_by("word").aggregate([("n", "max"), ("asked", "max"), ("listed", "max")]).sort_by("word")
        words, n = rows["word"].to_pylist(), rows["n_max"].to_numpy()
        asked = np.flatnonzero(rows["asked_max"].to_numpy(zero_copy_only=False))
        q, w = near_in_shard(words, asked, leftward=key[0].as_py() == 1)
        listed = rows["listed_max"].to_numpy(zero_copy_only=False)[w]
        q, w = q[listed], w[listed]
        return pa.table({"word": rows["word"].take(pa.array(q)), "near": rows["word"].take(pa.array(w)), "near_n": pa.array(n[w], pa.int64())})

    found = dealt.groupBy("side", "shard").applyInArrow(search, "word string, near string, near_n long")
    # one exchange by word for this step and what follows it
    return found.repartition("word").dropDuplicates(["word", "near"])


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of ``links`` (word, form), which has no circles; each round doubles the steps."""
    at = stored(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
                      "variants-roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def group_variants(words: DataFrame, ratio: int = 5, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct words).

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its near word of largest n
    (ties: the smallest in code-point order), if that n is at least ``ratio`` times the word's own; ``root`` is the end
    of the chain of forms, the word itself if it has none.  NULL words are left out; an empty table gives no rows.
    """
    words = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "variants-words")
    best = near_words(words, shard).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    big = -F.col("b.low") >= ratio * F.col("n")
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                  F.when(big, F.col("b.near")).alias("form"), F.when(big, -F.col("b.low")).alias("form_n")), "variants-forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, ratio: int = 5, every: int = 199, least_length: int = 6, least: int = 5, shard: int = SHARD) -> DataFrame:
    """``group_variants`` of ``word_counts``: the words of whole texts, with their near words' most frequent form.

    Equal texts and repeated rows all count; texts without words add nothing; an empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    return group_variants(word_counts(docs, every, least_length, least), ratio, shard)
