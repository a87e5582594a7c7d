"""Best-fit packing by minimum bin slack.

Per bin, a bitset subset-sum over the lengths that are left finds the fullest
feasible combination, which is then removed. Pieces are packed in groups of bounded
size. The few emptiest sequences of a group, if they are not full, are opened again: their
pieces go on to the next level of a tree, where fewer groups hold them, until one is left.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.tables import read_table, stored

CAPACITY = 2048
GROUP_PIECES = 8192
# Sequences that a group passes on; the others of its sequences are as full as its lengths allow.
OPEN_SEQUENCES = 16
VOCABULARY = "byte_bpe_50k.tiktoken"
# The same vocabulary as a tokenizer file: defines the ids, and takes texts that the rank file's reader cannot split.
TOKENIZER_FILE = "byte_bpe_50k.json"
# The added tokens of the tokenizer file, which the rank file does not have.
SPECIAL_TOKENS = {"<|endoftext|>": 50256}
END_ID = 0


@cache
def encoding(vocabulary: str):
    """The tokenizer of a rank file and ``SPECIAL_TOKENS``.

    ``encode`` with ``allowed_special="all"`` gives the ids of byte_bpe_50k.json, in a quarter of the time.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL_TOKENS)


@cache
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(text: str, vocabulary: str = VOCABULARY, tokenizer_file: str = TOKENIZER_FILE) -> list[int]:
    """The ids of a text. Special tokens in it are those tokens.

    The pattern that splits a text for the rank file gives up on very long runs of white space
    (about a million). Such a text is encoded with the tokenizer file, which has no such limit.
    """
    try:
        return encoding(vocabulary).encode(text, allowed_special="all")
    except ValueError as error:
        if "Regex error" not in str(error):
            raise
        return tokenizer(tokenizer_file).encode(text, add_special_tokens=False).ids


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; only the first may be shorter than a sequence."""
    if len(ids) <= capacity:
        starts = [0]
    else:
        starts = list(range(len(ids) % capacity or capacity, len(ids), capacity))
        starts.insert(0, 0)
    ends = [*starts[1:], len(ids)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(starts, ends)]


def tokenized_pieces(
    documents: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    tokenizer_file: str = TOKENIZER_FILE,
) -> DataFrame:
    """Rows (keys, piece, start, length, ids_crc32) of each document: its ids, then id 0.

    A null or empty text is the one id 0. Strings of special tokens are those tokens, as the
    tokenizer file has them; the two files must hold one vocabulary.
    """
    rows = documents.select(*keys, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for row, text in enumerate(batch.column(len(keys))):
                ids = np.array([*ids_of(text.as_py() or "", vocabulary, tokenizer_file), END_ID], "<u4")
                for number, piece in enumerate(pieces_of(ids, capacity)):
                    owner.append(row)
                    found.append((number, *piece))
            table = np.array(found, np.int64).reshape(-1, 4)
            index = pa.array(owner, pa.int64())
            columns = [batch.column(k).take(index) for k in range(len(keys))]
            columns += [pa.array(table[:, 0], pa.int32()), *[pa.array(table[:, k]) for k in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"{fields}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, present: list[int], room: int) -> list[int]:
    """Lengths, no more of each than ``counts`` has, whose sum is the largest within ``room``.

    ``present`` has the lengths in stock, longest first. A bit k of ``reached`` says
    that some of the lengths seen so far sum to k; the search ends once ``room`` is reached.
    """
    mask = (1 << (room + 1)) - 1
    reached, goal = 1, 1 << room
    trail: list[tuple[int, int]] = []  # a length, and what was reached before it
    for length in present:
        if length > room:
            continue
        for _ in range(min(int(counts[length]), room // length)):
            now = (reached | reached << length) & mask
            if now == reached:
                break
            trail.append((length, reached))
            reached = now
            if now & goal:
                break
        if reached & goal:
            break
    total = reached.bit_length() - 1
    chosen = []
    for length, before in reversed(trail):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin.

    The longest item left opens a bin, and the fullest combination of the others joins it.
    """
    order = np.argsort(-lengths, kind="stable")
    stock: dict[int, list[int]] = {}
    for item in order[::-1]:
        stock.setdefault(int(lengths[item]), []).append(int(item))
    counts = np.zeros(capacity + 1, np.int64)
    for length, items in stock.items():
        counts[length] = len(items)
    present = sorted(stock, reverse=True)
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    while present:
        opener = present[0]
        counts[opener] -= 1
        chosen = [opener, *fullest(counts, present, capacity - opener)]
        place = 0
        for k, length in enumerate(chosen):
            counts[length] -= k > 0
            item = stock[length].pop()
            bins[item], offsets[item] = len(fills), place
            place += length
        if any(not counts[length] for length in chosen):
            present = [length for length in present if counts[length]]
        fills.append(place)
    return bins, offsets, np.array(fills, np.int64)


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Equal rows are packed each for itself; they are counted first and numbered, so that many of
    them spread over groups. Which group a row joins depends on its values and number, so reruns
    agree. Sequence ids are unique numbers with gaps.
    """
    columns = pieces.columns
    copies = pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    numbered = copies.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    rest = stored(numbered.select(*columns, F.xxhash64(*columns, "_copy").alias("_seed")), "pieces")
    added = T.StructType().add("sequence_id", "long").add("offset", "long").add("_done", "boolean")
    schema = T.StructType(rest.schema.fields + added.fields)
    done: list[DataFrame] = []
    level, groups = 0, math.inf
    while True:
        # At most half as many groups as before, so that the tree ends.
        groups = max(1, min(math.ceil(rest.count() / group_pieces), math.ceil(groups / 2) if level else math.inf))
        group = F.pmod(F.col("_seed"), F.lit(groups))
        result = _pack_groups(rest, group, level, groups == 1, capacity, schema)
        if groups == 1:
            done.append(result)
            break
        result = stored(result, "packed")
        done.append(result.where("_done"))
        rest = result.where("NOT _done").drop("sequence_id", "offset", "_done")
        rest = rest.withColumn("_seed", F.xxhash64("_seed", F.lit(level)))
        level += 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.drop("_seed", "_done")


def _pack_groups(rows: DataFrame, group: Column, level: int, last: bool, capacity: int, schema) -> DataFrame:
    def pack(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["length", "_seed"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets, fills = minimum_bin_slack(table["length"].to_numpy(), capacity)
        # Level and group have 6 and 33 bits, the sequence within its group 24.
        first = (level << 57) | (int(key[0]) << 24)
        done = fills == capacity
        done[np.argsort(fills, kind="stable")[OPEN_SEQUENCES:]] = True
        return table.assign(sequence_id=first + bins, offset=offsets, _done=last | done[bins])

    return rows.groupBy(group.alias("_group")).applyInPandas(pack, schema)


def op4_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    pieces = tokenized_pieces(read_table(spark, sf_dir, "documents"))
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
