"""Packing documents into training sequences by bin completion.

Tokens, pieces and checksums are made where the texts are; what travels further is one narrow row per piece. The
packing itself works on the histogram of piece lengths, which has at most ``length`` entries however many documents
there are: bin completion takes the longest piece left, enumerates the undominated fillings of the room beside it
(no filling could swap a piece, or some pieces, for a longer piece that is left and fits), prunes by waste bounds,
and starts from the best-fit solution as incumbent. A filling is used as often as the counts allow, so the plan has a
row for each filling and not for each sequence. Full pieces are sequences of their own and need no rank. The others
find their sequence by their rank within their length, counted over range partitions, so that no length, however
common, meets in one task.

The search is bounded: per step at most ``FOUND`` fillings are gathered from ``LOOKS`` looked at, the best ``WIDTHS[-1]`` are
branched on, and ``NODES`` steps are made in all. Within these bounds it is exact; beyond them its result is the incumbent,
a whole valid packing that is never longer than the best-fit one.

Defined results: null or empty text is one piece with the end token alone; repeated rows are packed once each; a very
long text, whatever it is made of, gives the ids of the tokenizer file's own library; an empty table gives an empty
result; other columns of the input are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm.common import materialize, numbered, text_batches

LENGTH = 1024
END_TOKEN = 2
#: Steps of a search before it falls back on its incumbent, looks and fillings per step, and fillings branched on by round.
NODES = 20_000
LOOKS = 2_000
FOUND = 64
WIDTHS = (1, 2, 3)
#: Texts with an unbroken run of so many spaces or of so many other signs are run by the tokenizer file's own library.
LONG_RUN = 20_000
RUN = re.compile(r"\s+|\S+")


def encoder(path: str):
    """A function from a text to its ids, as the tokenizer file at path gives them without special tokens added.

    A byte-level BPE file that splits like its well-known pattern is run by the faster library on the same vocabulary;
    every other file by its own library. So are texts with very long runs: the faster one's pattern gives up on them.
    """
    tokenizer = Tokenizer.from_file(path)

    def own(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model, extra = spec["model"], spec["added_tokens"]
    usual = spec["normalizer"] is None and spec["pre_tokenizer"] == plain and model["type"] == "BPE" and not model.get("ignore_merges")
    usual = usual and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    usual = usual and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in extra)
    special = {t["content"]: t["id"] for t in extra}
    ordered = sorted((i, w) for w, i in model["vocab"].items() if w not in special)
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if not usual or [w for _, w in ordered[256:]] != merged or [i for i, _ in ordered] != list(range(len(ordered))):
        return own
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    ranks = {bytes(byte[c] for c in w): i for i, w in ordered}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        long = len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in RUN.finditer(text))
        return own(text) if long else fast.encode(text, allowed_special="all")

    return encode


def piece_bounds(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, but for the first."""
    first = (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_token: int = END_TOKEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for the documents, tokenized whole."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                row, piece, start, size, crc = [], [], [], [], []
                for k, text in enumerate(batch.column("text")):
                    ids = np.array([*encode(text.as_py() or ""), end_token], "<u4").tobytes()
                    for p, (s, n) in enumerate(piece_bounds(len(ids) // 4, length)):
                        row.append(k)
                        piece.append(p)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Filling:
    """Lengths that share a sequence, longest first, and in how many sequences."""

    lengths: tuple[int, ...]
    times: int


def best_fit(count: dict[int, int], length: int) -> list[Filling]:
    """The incumbent: the longest piece first, then again and again the longest that still fits."""
    left, plan = dict(count), []
    sizes = sorted(left)
    while sizes:
        room, chosen, used = length, [], {}
        while True:
            k = bisect_right(sizes, room) - 1
            while k >= 0 and left[sizes[k]] <= used.get(sizes[k], 0):
                k -= 1
            if k < 0:
                break
            s = sizes[k]
            n = min(room // s, left[s] - used.get(s, 0))
            chosen += [s] * n
            used[s] = used.get(s, 0) + n
            room -= n * s
        times = min(left[s] // n for s, n in used.items())
        plan.append(Filling(tuple(chosen), times))
        for s, n in used.items():
            left[s] -= n * times
        sizes = [s for s in sizes if left[s]]
    return plan


def fillings(largest: int, left: dict[int, int], length: int, waste: int, limit: int) -> list[tuple[int, ...]]:
    """Undominated fillings beside the largest piece that waste no more than `waste`, the least waste first."""
    room = length - largest
    sizes = sorted((s for s, n in left.items() if n - (s == largest) > 0 and s <= room), reverse=True)
    least = sizes[-1] if sizes else 0
    found: list[tuple[int, ...]] = []
    looked = 0

    def grow(k: int, rest: int, chosen: list[int]) -> None:
        nonlocal looked
        looked += 1
        if looked > limit or len(found) >= FOUND:
            return
        if rest <= waste and not dominated(rest, chosen):
            found.append(tuple(chosen))
            if rest == 0:
                return
        if not sizes or rest < least:
            return
        for j in range(k, len(sizes)):
            s = sizes[j]
            if s > rest:
                continue
            if chosen.count(s) < left[s] - (s == largest):
                chosen.append(s)
                grow(j, rest - s, chosen)
                chosen.pop()
            if looked > limit or found and sum(found[-1]) == room:
                return

    def dominated(rest: int, chosen: list[int]) -> bool:
        """Whether a piece that is left could be added, or put in place of a shorter one, and still fit."""
        for s in sizes:
            free = left[s] - (s == largest) - chosen.count(s)
            if free > 0 and (s <= rest or any(c < s <= c + rest for c in chosen)):
                return True
        return False

    grow(0, room, [])
    return sorted(set(found), key=lambda f: (-sum(f), len(f), tuple(-s for s in f)))


def complete_bins(count: dict[int, int], length: int, nodes: int = NODES) -> list[Filling]:
    """A packing of the histogram into as few sequences as the search finds; never more than the best-fit one."""
    incumbent = best_fit(count, length)
    total = sum(s * n for s, n in count.items())
    bound = ceil(total / length)
    over_half = sum(n for s, n in count.items() if 2 * s > length)
    bound = max(bound, over_half)
    best = sum(f.times for f in incumbent)
    looked = 0

    def search(left: dict[int, int], made: list[Filling], bins: int, spare: int, width: int) -> None:
        """spare: waste that a packing better than the incumbent may still have."""
        nonlocal incumbent, best, looked
        while left:
            looked += 1
            if bins + ceil(sum(s * n for s, n in left.items()) / length) >= best or looked > nodes:
                return
            largest = max(left)
            options = fillings(largest, left, length, min(spare, length), LOOKS)
            if not options:
                return
            for option in options[1:width]:
                step(dict(left), list(made), bins, spare, largest, option, width)
                if best <= bound or looked > nodes:
                    return
            left, made, bins, spare = take(left, made, bins, spare, largest, options[0])
        if bins < best:
            incumbent, best = made, bins

    def take(left: dict[int, int], made: list[Filling], bins: int, spare: int, largest: int, option: tuple[int, ...]) -> tuple:
        use: dict[int, int] = {}
        for s in (largest, *option):
            use[s] = use.get(s, 0) + 1
        waste = length - largest - sum(option)
        times = min(left[s] // n for s, n in use.items())
        if waste:
            times = max(1, min(times, spare // waste))
        for s, n in use.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        made.append(Filling((largest, *option), times))
        return left, made, bins + times, spare - waste * times

    def step(left: dict[int, int], made: list[Filling], bins: int, spare: int, largest: int, option: tuple[int, ...], width: int) -> None:
        search(*take(left, made, bins, spare, largest, option), width)

    for width in WIDTHS:
        if best <= bound:
            break
        search(dict(count), [], 0, (best - 1) * length - total, width)
    return incumbent


def placements(plan: list[Filling]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks per length: (length, first rank, pieces per sequence, first sequence, first offset), sorted."""
    done: dict[int, int] = {}
    rows, sequence = [], 0
    for filling in plan:
        offset = 0
        for s in dict.fromkeys(filling.lengths):
            n = filling.lengths.count(s)
            rows.append((s, done.get(s, 0), n, sequence, offset))
            done[s] = done.get(s, 0) + n * filling.times
            offset += n * s
        sequence += filling.times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else tuple(np.zeros((5, 0), np.int64))


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """The materialized pieces with sequence_id and offset; full pieces have negative sequence numbers of their own."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.where(F.col("length") >= length).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < length).select(*names)
    count = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}  # fewer than `length` rows
    table = placements(complete_bins(count, length))
    ranked = numbered(rest, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, each, sequence, offset = table
        order = size << 44 | rank
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            r = r - 1
            k = np.searchsorted(order, n << 44 | r, side="right") - 1
            within = r - rank[k]
            placed = sequence[k] + within // each[k], offset[k] + within % each[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, placed)], names=[*names, "sequence_id", "offset"])

    found = ranked.select(*names, "rank").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(found)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    with text_batches(spark):
        rows = materialize(pieces(docs, tokenizer_path, length), "pack-pieces")
    return pack(rows, length)
