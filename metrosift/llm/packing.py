"""Packing tokenized documents into sequences, certified by lower bounds.

Pieces are packed by best-fit decreasing within parts. Dual feasible functions give each
part a number of sequences that no packing can go below. Where a part uses more, its
least filled sequences are opened again and their pieces are dealt, with those of other
such parts, into new parts, until every part is certified or nothing is gained.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import table
from metrosift.llm.token_counts import TOKENIZER, chunks, encoder, tokenizer_path
from metrosift.session import stage

LENGTH = 2048
#: Pieces a part is made of; the number of parts grows with the pieces.
PER_PART = 20_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions.

    u_e takes lengths over capacity - e as whole sequences and drops those below e; f_k
    rounds to multiples of 1/k, as a sum of rounded-down shares may not pass one.
    """
    if not len(lengths):
        return 0
    values, counts = np.unique(lengths, return_counts=True)
    values = values.astype(np.int64)
    best = -(-int((values * counts).sum()) // capacity)
    for e in np.unique(np.concatenate((values[values <= capacity // 2], capacity - values[values > capacity // 2] + 1))):
        if e > capacity // 2:
            continue
        f = np.where(values > capacity - e, capacity, np.where(values < e, 0, values))
        best = max(best, -(-int((f * counts).sum()) // capacity))
    for k in range(1, 101):
        scaled = values * (k + 1)
        whole = scaled % capacity == 0
        # f_k(x) = x where (k+1)x is whole, else floor((k+1)x)/k; times capacity * k to stay in integers
        f = np.where(whole, values * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((f * counts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece.

    Open sequences lie in stacks by free room; a bit set of the rooms in use finds the
    smallest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, own, made = capacity, made, made + 1
        bins[i], offsets[i] = own, capacity - room
        if room > length:
            stacks[room - length].append(own)
            rooms |= 1 << (room - length)
    return bins, offsets


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
               tokenizer: str = TOKENIZER, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its tokens and then ``end_id``, so an empty or null text is one token
    long. Only longer documents are cut; the first piece takes what whole pieces leave.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0
            for part in chunks(batch.column(1)):
                ids, sizes = own.encode(part)
                ends, rows = np.cumsum(sizes), []
                done += len(part)
                for name, size, end in zip(names[done - len(part):done], sizes.tolist(), ends.tolist()):
                    all_ids = np.append(ids[end - size:end], end_id).astype("<u4")
                    stop = len(all_ids) % length or length
                    start = piece = 0
                    while start < len(all_ids):
                        own_ids = all_ids[start:stop]
                        row = (name, piece, start, len(own_ids), zlib.crc32(own_ids.tobytes()))
                        rows.append(row + (own_ids.view(np.int32),) * keep_ids)
                        start, stop, piece = stop, stop + length, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kind = _PIECE + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, kind)


def _packer(turn: int, capacity: int, last: bool):
    """Packs one part; unless it is the last turn, sequences are opened where the bound is missed."""

    def pack(rows: pa.Table) -> pa.Table:
        number = rows["__part"][0].as_py()
        # Arrow keeps ids whole beside a null one
        rows = rows.drop_columns("__part").sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = rows["length"].to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        gap = 0 if last else used - lower_bound(lengths, capacity)
        fill, opened = np.bincount(bins, lengths), np.zeros(used, bool)
        if gap > 0:
            # enough loose sequences for the pooled pieces to find partners among other parts' pieces
            loose = np.argsort(fill, kind="stable")[: max(8 * gap, used // 20)]
            opened[loose[fill[loose] < capacity]] = True
        found = {"sequence_id": (turn << 48) + (number << 24) + bins, "offset": offsets, "open": opened[bins]}
        for name, column in found.items():
            rows = rows.append_column(name, pa.array(column))
        return rows

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH, per_part: int = PER_PART) -> DataFrame:
    """``pieces`` with sequence_id and offset added; ``length`` is 1 to ``capacity``.

    Parts hold about ``per_part`` pieces dealt by hash, so no part grows with the input
    or with a key. A round's kept sequences are written down; only opened pieces go on,
    as long as they fit in more than one part and get fewer by a tenth at least.
    """
    columns = pieces.columns
    kind = f"{pieces.schema.simpleString()[7:-1].replace(':', ' ')}, sequence_id long, offset long, open boolean"
    found, waiting, n, before, turn = [], pieces, pieces.count(), None, 0
    while True:
        parts = max(1, -(-n // per_part))
        last = turn > 0 and (parts == 1 or n * 10 > before * 9)
        dealt = waiting.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)))
        done = stage(dealt.repartition(parts, "__part").groupBy("__part").applyInArrow(
            _packer(turn, capacity, last), kind), "packed")
        found.append(done.where("not open"))
        before, waiting, turn = n, done.where("open").select(columns), turn + 1
        n = waiting.count()
        if n == 0:
            break
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.drop("open")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   tokenizer: str = TOKENIZER, keep_ids: bool = False, per_part: int = PER_PART) -> DataFrame:
    """Pieces of ``docs`` packed into sequences of at most ``length`` tokens.

    Columns: doc_id, piece, start, length, ids_crc32 (ids if asked for), sequence_id,
    offset. Every row gives its pieces; repeated rows give repeated pieces, each with a
    place of its own. Null texts are empty, null ids stay null, other columns are not
    carried, and no documents give no pieces.
    """
    pieces = stage(cut_pieces(docs, doc_id, text, length, tokenizer, keep_ids=keep_ids), "pieces")
    return pack_pieces(pieces, length, per_part)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
