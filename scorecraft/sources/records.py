"""Records of quoted CSV files, read in byte ranges, in file order.

Spark's own ``multiLine`` reader takes a whole file per task, because a line
break may lie inside quotes and a range cannot tell whether it begins inside one.
Here files are read as lines, which Spark splits into ranges.  A first pass
works out, for each range, where it would end (inside quotes or not) and how many
records it would begin, for both ways it may begin.  Chained along each file, one
small row a range, that gives the true state and the first record number of
every range.  A second pass then cuts each range into records.  The pieces of a
record that crosses ranges, at most two a range, are put together by record number.

Quotes follow RFC 4180: a field that begins with a quote lasts to the next single
quote, a doubled one stands for itself, and a quote inside a bare field is an
ordinary character.  Every record gets ``pos``, its number in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT, IN = 0, 1


def end_state(line: str, state: int) -> int:
    """Whether the end of ``line`` lies inside quotes, if its start does or not."""
    i = 0
    if state == OUT:
        while line[i:i + 1] != '"':  # at a field's start
            i = line.find(",", i) + 1
            if not i:
                return OUT
        i += 1
    while True:  # inside quotes
        i = line.find('"', i)
        if i < 0:
            return IN
        if line[i + 1:i + 2] == '"':
            i += 2
            continue
        while True:  # after a closing quote: the next field that begins with one
            i = line.find(",", i) + 1
            if not i:
                return OUT
            if line[i:i + 1] == '"':
                break
        i += 1


def states(lines: pa.Array, state: int) -> tuple[np.ndarray, int]:
    """State before each line, and after the last; only lines with a quote are looked at one by one."""
    before = np.empty(len(lines), np.int8)
    at = 0
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
        before[at:k + 1] = state
        state = end_state(lines[int(k)].as_py(), state)
        at = int(k) + 1
    before[at:] = state
    return before, state


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, lines) of the stretches of one range in a batch."""
    if not batch.num_rows:
        return
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    cut = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield file[int(a)].as_py(), int(start[a]), batch.column("value").slice(a, b - a)


def _filled(lines: pa.Array) -> np.ndarray:
    """Lines that hold anything but a carriage return."""
    return np.asarray(pc.not_equal(pc.utf8_rtrim(lines, "\r"), "").to_numpy(zero_copy_only=False))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: end state and number of records begun, for either state at its beginning."""
    key, ends, begun = None, [OUT, IN], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array([key[0]]), "start": pa.array([key[1]], pa.int64()),
                                           "out_end": pa.array([ends[0]], pa.int32()), "in_end": pa.array([ends[1]], pa.int32()),
                                           "out_begun": pa.array([begun[0]], pa.int64()), "in_begun": pa.array([begun[1]], pa.int64())})

    for batch in batches:
        for file, start, lines in _ranges(batch):
            if key != (file, start):
                if key is not None:
                    yield row()
                key, ends, begun = (file, start), [OUT, IN], [0, 0]
            filled = _filled(lines)
            for way in (OUT, IN):
                before, ends[way] = states(lines, ends[way])
                begun[way] += int(((before == OUT) & filled).sum())
    if key is not None:
        yield row()


def _chain(found: list) -> tuple[dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], list[str]]:
    """Per file: starts of its ranges, the state each begins in, and the number of its first record; and the files with pieces.

    Pieces are in files where a range begins or the file ends inside quotes.
    """
    out = {}
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        starts, begins, firsts, state, n = out.setdefault(r["file"], ([], [], [], [OUT], [0]))
        starts.append(r["start"])
        begins.append(state[0])
        firsts.append(n[0])
        n[0] += r["in_begun"] if state[0] else r["out_begun"]
        state[0] = r["in_end"] if state[0] else r["out_end"]
    open_ = [f for f, (_, begins, _, state, _) in out.items() if any(begins) or state[0]]
    return {f: (np.array(a, np.int64), np.array(b, np.int8), np.array(c, np.int64)) for f, (a, b, c, _, _) in out.items()}, open_


def _cut(chain, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, pos, start, whole, record): the records of each range, and the pieces of those that cross its ends."""
    key, state, pos, held, held_pos, first_piece = None, OUT, 0, [], -1, False

    def rows(file, start, poss, whole, texts) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.string()), "pos": pa.array(poss, pa.int64()),
                                           "start": pa.array([start] * n, pa.int64()), "whole": pa.array([whole] * n, pa.bool_()),
                                           "record": texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())})

    for batch in batches:
        for file, start, lines in _ranges(batch):
            if key != (file, start):
                if held:
                    yield rows(key[0], key[1], [held_pos], False, ["\n".join(held)])
                key, held = (file, start), []
                starts, begins, firsts = chain.value[file]
                k = int(np.searchsorted(starts, start))
                if k == len(starts) or starts[k] != start:
                    raise RuntimeError(f"{file} was split in another way than at first")
                state, pos = int(begins[k]), int(firsts[k])
                first_piece = state == IN
                held_pos = pos - 1
            before, end = states(lines, state)
            after = np.append(before[1:], end)
            single = (before == OUT) & (after == OUT) & _filled(lines)
            begun = (before == OUT) & _filled(lines)
            number = pos + np.cumsum(begun) - 1
            if single.any():
                at = np.flatnonzero(single)
                yield rows(file, start, number[at], True, lines.take(pa.array(at)))
            # records of several lines
            many = np.flatnonzero((before == IN) | (after == IN))
            done_pos, done, pieces = [], [], []
            for j in many:
                if before[j] == OUT:
                    held, held_pos, first_piece = [], int(number[j]), False
                held.append(lines[int(j)].as_py())
                if after[j] == OUT:
                    if first_piece:
                        pieces.append((held_pos, "\n".join(held)))
                    else:
                        done_pos.append(held_pos)
                        done.append("\n".join(held))
                    held, first_piece = [], False
            if done:
                yield rows(file, start, done_pos, True, done)
            for p, text in pieces:
                yield rows(file, start, [p], False, [text])
            pos += int(begun.sum())
            state = end
    if held:
        yield rows(key[0], key[1], [held_pos], False, ["\n".join(held)])


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, pos, record): every record of the files, ``pos`` from 0 within its file, the header too.

    Empty lines between records are no records.  The line break inside quotes is kept as it
    stands; a carriage return before the break that ends a record is not part of it.
    One job over the files runs at once (a row a range comes to the driver); the rows are lazy.
    Files must not change between the two.
    """
    lines = _lines(spark, path)
    found = lines.mapInArrow(_scan_ranges, "file string, start long, out_end int, in_end int, out_begun long, in_begun long").collect()
    chain, crossed = _chain(found)
    shared = spark.sparkContext.broadcast(chain)

    def cut(batches):
        return _cut(shared, batches)

    schema = "file string, pos long, start long, whole boolean, record string"
    rows = lines.mapInArrow(cut, schema)
    out = rows.where("whole").select("file", "pos", "record")
    if crossed:
        listed = spark.createDataFrame([(f,) for f in crossed], "file string")
        pieces = rows.where(~F.col("whole")).join(F.broadcast(listed), "file", "left_semi").groupBy("file", "pos").agg(
            F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"))
        out = out.unionByName(pieces.select("file", "pos", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    return out.select(F.col("file").alias("source_file"), "pos", F.regexp_replace("record", r"\r\z", "").alias("record"))


def parse_records(records: DataFrame, schema: str, bad: str = "_bad") -> DataFrame:
    """``source_file``, ``pos`` (from 0, without the header) and the columns of ``schema``; ``_bad`` holds the text of a record that does not fit it."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    data = records.where("pos > 0").withColumn("pos", F.col("pos") - 1)
    return data.withColumn("_r", F.from_csv("record", f"{schema}, {bad} string", options)).select("source_file", "pos", "_r.*")
