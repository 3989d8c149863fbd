"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

Inside a task DuckDB aligns a slice of texts.  Both tokenizers' tokens are
tables of byte intervals over the slice.  An ASOF join gives each A token the
last B token that ends no later: equal ends are cuts, and equal intervals are
links of one token to one.  A window sum of the cuts numbers the groups.  What
is left, groups in which the two divide differently, meets its B tokens in a
range join, and the tokens of a group are linked through their counts, so a
group of many tokens makes a row per pair of ids and not per pair of places.

How many documents hold a pair is known only in the end.  A chunk of documents
writes a dictionary of its pairs with partial counts, and each document the
places of its pairs in that dictionary.  Spark adds the partial counts up and
returns the sums to the chunks, where documents and dictionary meet again.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .packing import byte_alphabet
from .store import Scratch

#: Bytes of text that DuckDB aligns at once, and that share a dictionary; a longer text is a slice, or a chunk, of its own.
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 16 << 20
#: Pairs in a dictionary row.
CELL_PAIRS = 1 << 16
#: What DuckDB may hold in a task; it works in memory alone.
DUCK_MEMORY = "512MB"
_SHIFT = 20  # a pair of ids in one number: A's id above B's

#: The byte-level word pattern, a fixed value of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
Encode = Callable[[list[str]], list[list[int]]]
_coders: dict[tuple[str, str], tuple[Encode, list[bytes]]] = {}


def byte_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder of space+text and the bytes of each id, for a byte-level BPE whose ids follow its merges; special tokens are plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, letters = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}, byte_alphabet()
    vocab = spec["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError("ids do not follow the merges")
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
    spelled = [b""] * (max(vocab.values()) + 1)
    for word, i in ranks.items():
        spelled[i] = word
    coder = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [coder.encode_ordinary(" " + t) for t in texts], spelled


def pieces(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder and the bytes of each id for a SentencePiece model, which puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
    return lambda texts: model.encode(texts, num_threads=1), spelled


def coders(a_path: str, b_path: str):
    key = (a_path, b_path)
    if key not in _coders:
        _coders[key] = (*byte_level(a_path), *pieces(b_path))
    return _coders[key]


class Spelling:
    """Byte strings of ids, end to end; those of many ids are gathered at once."""

    def __init__(self, words: list[bytes]):
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids one after another, and where each ends."""
        ends = self.ends(ids)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if total < 1 << 31 else np.int64
        size = self.size[ids]
        at = np.repeat((self.at[ids] - (ends - size)).astype(narrow), size)
        at += np.arange(total, dtype=narrow)
        return self.flat[at], ends

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in ids], dtype=np.int64)
    return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(size.sum())), size


ALIGN = """
CREATE OR REPLACE TEMP TABLE grouped AS
  SELECT doc, id, s, e, twin, (sum(cut) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - cut)::INT AS g FROM (
    SELECT a.doc, a.id, a.s, a.e, coalesce(a.e = b.e, false)::INT AS cut, CASE WHEN a.e = b.e AND a.s = b.s THEN b.id END AS twin FROM a ASOF LEFT JOIN b ON a.e >= b.e);
CREATE OR REPLACE TEMP TABLE wide AS SELECT g, min(doc) AS doc, min(s) AS lo, max(e) AS hi, count(*) AS na FROM grouped WHERE twin IS NULL GROUP BY g;
CREATE OR REPLACE TEMP TABLE loose AS
  SELECT w.g, b.id FROM (SELECT id, s, e FROM b ANTI JOIN (SELECT e FROM grouped WHERE twin IS NOT NULL) t ON b.e = t.e) b JOIN wide w ON b.s >= w.lo AND b.e <= w.hi;
"""
#: Each group's document and its numbers of A and B tokens, in order of place.
GROUPS = """
SELECT doc, na, nb FROM (
  SELECT e, doc, 1 AS na, 1 AS nb FROM grouped WHERE twin IS NOT NULL
  UNION ALL SELECT w.hi, w.doc, w.na, l.nb FROM wide w JOIN (SELECT g, count(*) AS nb FROM loose GROUP BY g) l USING (g))
ORDER BY e
"""
#: The pairs of ids of each document and how often they are linked.
LINKS = f"""
SELECT doc, pair, sum(n)::BIGINT AS n FROM (
  SELECT doc, (id::BIGINT << {_SHIFT}) + twin AS pair, count(*) AS n FROM grouped WHERE twin IS NOT NULL GROUP BY ALL
  UNION ALL SELECT doc, (x.id::BIGINT << {_SHIFT}) + y.id, x.n * y.n
    FROM (SELECT doc, g, id, count(*) AS n FROM grouped WHERE twin IS NULL GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS n FROM loose GROUP BY ALL) y USING (g))
GROUP BY ALL ORDER BY doc, pair
"""


def connect():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": ""})


class Slice:
    """The alignment of some texts: numbers of each text, its groups as text, and its pairs."""

    def __init__(self, con, texts: list[str | None], paths: tuple[str, str]):
        a_encode, a_words, b_encode, b_words = coders(*paths)
        n = len(texts)
        own = [t or "" for t in texts]
        (a, na), (b, nb) = _flat(a_encode(own)), _flat(b_encode(own))
        ok = np.array([t != "" for t in own], dtype=bool) & self._same(own, _spelling(a_words).ends(a), na, *_spelling(b_words).gather(b), nb)
        # texts that cannot be aligned have no tokens
        self.n_a, self.n_b = np.where(ok, na, 0), np.where(ok, nb, 0)
        a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
        self.pair_doc, self.pair, self.pair_n = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.n_groups, self.sha = np.zeros(n, dtype=np.int64), [""] * n
        if not ok.any():
            return
        for name, ids, count, words in (("a", a, self.n_a, a_words), ("b", b, self.n_b, b_words)):
            e = _spelling(words).ends(ids)
            kind = np.int32 if e[-1] < 1 << 31 else np.int64
            con.register(f"{name}_arrow", pa.table({"doc": np.repeat(np.arange(n, dtype=np.int32), count), "id": ids, "s": (e - _spelling(words).size[ids]).astype(kind), "e": e.astype(kind)}))
            con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM {name}_arrow")
            con.unregister(f"{name}_arrow")
        for statement in ALIGN.split(";")[:-1]:
            con.execute(statement)
        groups = {k: v.astype(np.int64) for k, v in con.execute(GROUPS).fetchnumpy().items()}
        links = con.execute(LINKS).fetchnumpy()
        self.pair_doc, self.pair, self.pair_n = (np.asarray(links[k], dtype=np.int64) for k in ("doc", "pair", "n"))
        self.n_groups = np.bincount(groups["doc"], minlength=n)
        self.strings = _written(a, b, groups["na"], groups["nb"], np.cumsum(self.n_groups))
        self.sha = [hashlib.sha256(s).hexdigest() if s else "" for s in self.strings]

    @staticmethod
    def _same(texts: list[str], a_ends: np.ndarray, na: np.ndarray, b_bytes: np.ndarray, b_ends: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether both sides spell a space and the text.  A's tokens divide its bytes, so their number tells; B's are compared."""
        a_at, b_at = (np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))] for ends, count in ((a_ends, na), (b_ends, nb)))
        out = np.diff(a_at) == np.diff(b_at)
        for i, t in enumerate(texts):
            if out[i]:
                w = b" " + t.encode()
                out[i] = a_at[i + 1] - a_at[i] == len(w) and b_bytes[b_at[i] : b_at[i + 1]].tobytes() == w
        return out


_spellings: dict[int, Spelling] = {}


def _spelling(words: list[bytes]) -> Spelling:
    if id(words) not in _spellings:  # the lists live as long as the process
        _spellings[id(words)] = Spelling(words)
    return _spellings[id(words)]


_digits = [str(i).encode() + b" " for i in range(1 << 17)]


def _written(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, last: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document, whose groups end before ``last``."""
    before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    at_a = np.arange(len(a)) + np.repeat(before_b, na)
    at_b = np.arange(len(b)) + np.repeat(before_a + na, nb)
    ids, stop = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids[at_a], ids[at_b] = a, b
    ends = before_a + na + before_b + nb
    stop[before_b + before_a + na - 1] = ord("|")
    stop[ends - 1] = ord(";")
    data, at = _spelling(_digits).gather(ids)
    data[at - 1] = stop
    bound = np.concatenate(([0], at))[np.concatenate(([0], ends))[np.concatenate(([0], last))]]
    whole = data.tobytes()
    return [whole[x : max(x, y - 1)] for x, y in zip(bound, bound[1:])]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as the planes of their bytes, compressed: small ones take little room."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _spread(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _chunk(number: int, ids: list[pa.Array], slices: list[Slice], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: its documents, then its dictionary, pairs of most documents first."""
    pairs = np.concatenate([s.pair for s in slices])
    known, place, held = np.unique(pairs, return_inverse=True, return_counts=True)
    order = np.argsort(-held, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    place, done = rank[place], 0
    for own, s in zip(ids, slices):
        n = len(own)
        bound = np.searchsorted(s.pair_doc, np.arange(n + 1))
        at, blobs, sums = place[done : done + len(s.pair)], [], np.zeros(n, dtype=np.int64)
        done += len(s.pair)
        for i, (x, y) in enumerate(zip(bound, bound[1:])):
            by = np.argsort(at[x:y])
            blobs.append(_squeezed(np.concatenate((np.diff(at[x:y][by], prepend=0), s.pair_n[x:y][by]))) if y > x else b"")
            sums[i] = s.pair_n[x:y].sum()
        none = pa.nulls(n, pa.list_(pa.int64()))
        columns = [pa.array(np.full(n, number)), own, *(pa.array(v.astype(np.int64)) for v in (s.n_a, s.n_b, s.n_groups, sums, np.diff(bound))), pa.array(s.sha), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), none, none]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    for first in range(0, len(order), CELL_PAIRS):
        part = order[first : first + CELL_PAIRS]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(v[part].astype(np.int64))) for v in (known, held)]
        columns = [pa.array([number]), pa.nulls(1, ids[0].type), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([first]), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=names)


_NAMES = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "groups_sha256", "places", "first", "pairs", "held"]


def _aligner(paths: tuple[str, str], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, ids, slices, size = connect(), [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, buf, _ in B.pieces(batch.column(1), SLICE_BYTES):
                if slices and size + len(buf) > chunk_bytes:
                    yield from _chunk(number, ids, slices, _NAMES)
                    number, ids, slices, size = number + 1, [], [], 0
                s = Slice(con, batch.column(1).slice(a, b - a).to_pylist(), paths)
                s.strings = None
                ids.append(batch.column(0).slice(a, b - a))
                slices.append(s)
                size += len(buf)
        if slices:
            yield from _chunk(number, ids, slices, _NAMES)
        con.close()

    return run


def _counter(names: list[str]):
    def run(docs: pa.Table, cells: pa.Table) -> pa.Table:
        order = np.argsort(cells["place"].to_numpy())
        counts = np.stack([cells["count"].to_numpy(), cells["best"].to_numpy().astype(np.int64)], axis=1)[order]
        sums = np.zeros((docs.num_rows, 2), dtype=np.int64)
        for i, (blob, n) in enumerate(zip(docs["places"].to_pylist(), docs["n_pairs"].to_pylist())):
            if n:
                numbers = _spread(blob, 2 * n)
                sums[i] = numbers[n:] @ counts[np.cumsum(numbers[:n])]
        out = docs.select(names)
        return out.append_column("n_best", pa.array(sums[:, 1])).append_column("count_sum", pa.array(sums[:, 0]))

    return run


def align(docs: DataFrame, a_tokenizer: str, b_tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    A is a byte-level BPE file, B a SentencePiece model; special tokens that a
    text spells out are plain text.  Texts that are null or empty, or whose
    tokens do not spell a space and the text, have no tokens: zeros and an
    empty string.  Every row is a document of its own, rows that repeat an id
    or have none included; an empty table gives an empty one, and further
    columns are left.  A text longer than a slice is aligned alone and whole;
    of a group that holds it all, what is kept is a row for each pair of ids.
    """
    disk = Scratch(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_pairs long, groups_sha256 string, places binary, first long, pairs array<long>, held array<long>"
    made = disk.keep(narrow.mapInArrow(_aligner((a_tokenizer, b_tokenizer), chunk_bytes), schema))
    listed = made.filter("pairs is not null").select("chunk", "first", F.posexplode(F.arrays_zip("pairs", "held")).alias("pos", "cell"))
    cells = listed.select("chunk", (F.col("first") + F.col("pos")).alias("place"), F.col("cell.pairs").alias("pair"), F.col("cell.held").alias("held"))
    counts = disk.keep(cells.groupBy("pair").agg(F.sum("held").alias("count")))
    # an A id meets at most as many B ids as there are
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", _SHIFT)))
    known = counts.select("pair", "count", (F.col("count") == most).alias("best"))
    back = cells.join(known, "pair").select("chunk", "place", "count", "best")
    rows = made.filter("pairs is null").select(F.col("chunk").alias("own"), *_NAMES[1:9])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = rows.groupBy("own").cogroup(back.groupBy("chunk")).applyInArrow(_counter(names), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(docs: DataFrame, a_tokenizer: str, b_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, groups``: each document's groups as text, ``a1,a2|b1;a3|b2,b3``; null where it has no tokens."""
    paths = (a_tokenizer, b_tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            for a, b, _, _ in B.pieces(batch.column(1), SLICE_BYTES):
                s = Slice(con, batch.column(1).slice(a, b - a).to_pylist(), paths)
                strings = [x.decode() or None for x in getattr(s, "strings", None) or [b""] * (b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(strings, pa.string())], names=["doc_id", "groups"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, groups string")
