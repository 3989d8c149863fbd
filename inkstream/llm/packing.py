"""Best-fit packing of token pieces under several capacities.

Texts become ids once; what is shuffled is a row of numbers per piece.  Pieces
are dealt by hash over shards of a bounded size.  A shard is packed by vector
best fit: longest first, each piece goes to the open sequence that it fits
under every capacity (tokens, documents, attention cost) and that it leaves
with the least weighted norm of what remains.  A shard costs at most one
half-empty sequence more than packing everything together would.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .store import Scratch

TOKENS = 1024
SEPARATOR = 2
SHARD_PIECES = 16384
#: Weights of what remains of tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.02, 0.05)

_encoders: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids for a tokenizer file, as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Nothing is added around a text; an added token that a text spells out is
    its one id.  A byte-level BPE whose ids follow the order of its merges,
    with the usual word pattern, gives the same ids through ``tiktoken``,
    several times faster; every other file goes through ``tokenizers``.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _encoders[path] = _fast(spec) or _general(path)
    return _encoders[path]


def _general(path: str) -> Callable[[list[str]], list[list[int]]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _fast(spec: dict) -> Callable[[list[str]], list[list[int]]] | None:
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, letters = model["vocab"], byte_alphabet()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    added = spec.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    # added tokens that take in spaces around them, need word ends or begin alike are left to the general way
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added) or any(a != b and a.startswith(b) for a in special for b in special):
        return None
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
    import tiktoken

    # the word pattern of byte-level pre-tokenizers, a fixed value
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [coder.encode(t, allowed_special="all") for t in texts]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids; only the first may be short."""
    head = n % most or most
    return [(0, min(head, n))] + [(s, most) for s in range(head, n, most)]


def _piecer(path: str, most: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for a, b, _, _ in B.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                rows, kept = [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    flat = np.array([*ids, end], dtype="<u4")
                    for piece, (start, length) in enumerate(cut(len(flat), most)):
                        own = flat[start : start + length]
                        rows.append((i, piece, start, length, zlib.crc32(own.tobytes())))
                        if keep_ids:
                            kept.append(own)
                i, piece, start, length, crc = (np.array(x) for x in zip(*rows))
                columns = [part.column(0).take(pa.array(i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                if keep_ids:
                    columns.append(pa.array(kept, type=pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = TOKENS, end: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``, of every document.

    A null text is empty and gives one piece that holds the end id alone; an
    empty table has no pieces, and further columns are left.
    Texts are encoded about a megabyte at a time; a longer one alone, whole,
    for ids do not end at any cut.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return narrow.mapInArrow(_piecer(tokenizer, most, end, keep_ids), schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given; a piece needs its length, one document and its length squared."""
    cap, w = np.array(capacity, dtype=float), np.array(weights, dtype=float)
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    if (need > cap).any():
        raise ValueError("a piece exceeds a capacity")
    left = np.empty((1024, 3))
    number = np.empty(1024, dtype=np.int64)
    open_bins, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    shortest = need.min(axis=0) if n else cap
    for k, i in enumerate(order):
        x = need[i]
        after = left[:open_bins] - x
        norm = np.where((after >= 0).all(axis=1), ((after / cap) ** 2 * w).sum(axis=1), np.inf)
        best = int(norm.argmin()) if open_bins else -1
        if best < 0 or norm[best] == np.inf:
            if open_bins == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            best, open_bins = open_bins, open_bins + 1
            left[best], number[best], made = cap, made, made + 1
        bins[i], offsets[i] = number[best], cap[0] - left[best, 0]
        left[best] -= x
        if (left[best] < shortest).any():  # nothing fits any more
            open_bins -= 1
            left[best], number[best] = left[open_bins], number[open_bins]
    return bins, offsets


def _packer(capacity: tuple[float, float, float]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = rows["shard"] * (1 << 32) + bins
        rows["offset"] = offsets
        return rows.drop(columns="shard")

    return run


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: float | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, start, length``.

    ``documents`` and ``attention`` bound the pieces of a sequence and the sum
    of their squared lengths; left out, tokens alone bind.  Repeated rows are
    packed one by one and dealt over all shards like others; of pieces that
    are as long, the smaller id and then the earlier piece is placed first.
    An empty table gives an empty one; further columns of pieces stay.
    """
    disk = Scratch(pieces.sparkSession)
    pieces = disk.keep(pieces)
    shards = max(1, -(-pieces.count() // shard_pieces))
    capacity = (float(tokens), float(documents or tokens), float(attention or tokens**2))
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"])
    return keyed.groupBy("shard").applyInPandas(_packer(capacity), schema)
